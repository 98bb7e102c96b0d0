"""LoRaWAN PHY payload decoding as one expression tree over the payload's hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterglass.functions.exprs import base64_to_hex, reverse_octets

FIELDS = ("AppEUI", "AppNonce", "CFList", "CFListType", "DLSettings", "DevAddr", "DevEUI", "DevNonce", "FCnt", "FCtrl", "FOpts", "FPort", "MHDR", "MIC", "PHYPayloadLen", "RxDelay")
JOIN_REQUEST, JOIN_ACCEPT = 0, 1


def decode_hex(h: Column) -> dict[str, Column]:
    """The fields of a payload given as upper-case hex; null where a frame of its type has no such field."""
    n = F.length(h)
    cut = lambda a, b: F.substring(h, a + 1, b - a)
    body = F.substring(h, F.lit(1), F.greatest(n - 8, F.lit(0)))
    piece = lambda a, b: F.substring(body, a + 1, b - a)
    mhdr = cut(0, 2)
    whole = n >= 12
    kind = F.shiftright(F.conv(mhdr, 16, 10).cast("int"), 5)
    request, accept = whole & (kind == JOIN_REQUEST), whole & (kind == JOIN_ACCEPT)
    data = whole & ~kind.isin(JOIN_REQUEST, JOIN_ACCEPT)
    control = piece(10, 12)
    complete = F.length(control) == 2
    options = F.when(complete, F.conv(control, 16, 10).cast("int").bitwiseAND(F.lit(15)) * 2).otherwise(0)
    fopts = F.when(complete, F.substring(body, F.lit(17), options)).otherwise("")
    fport = F.when(complete, F.substring(body, F.lit(17) + F.length(fopts), F.lit(2))).otherwise("")
    rest = F.substring(h, F.lit(27), F.greatest(n - 8 - 26, F.lit(0)))
    return {
        "AppEUI": F.when(request, reverse_octets(cut(2, 18))),
        "AppNonce": F.when(accept, reverse_octets(cut(2, 8))),
        "CFList": F.when(accept, F.substring(rest, F.lit(1), F.greatest(F.length(rest) - 2, F.lit(0)))),
        "CFListType": F.when(accept, F.right(rest, F.lit(2))),
        "DLSettings": F.when(accept, cut(22, 24)),
        "DevAddr": F.when(accept, reverse_octets(cut(14, 22))).when(data, reverse_octets(piece(2, 10))),
        "DevEUI": F.when(request, reverse_octets(cut(18, 34))),
        "DevNonce": F.when(request, reverse_octets(cut(34, 38))),
        "FCnt": F.when(data, reverse_octets(piece(12, 16))),
        "FCtrl": F.when(data, control),
        "FOpts": F.when(data, fopts),
        "FPort": F.when(data, fport),
        "MHDR": F.when(whole, mhdr),
        "MIC": F.when(whole, F.right(h, F.lit(8))),
        "PHYPayloadLen": F.when(n > 0, n.cast("long")),
        "RxDelay": F.when(accept, cut(24, 26)),
    }


def decode_base64(data: Column) -> Column:
    """The fields as a struct, from a base64 payload; null and '' give nulls throughout."""
    h = base64_to_hex(F.when(data != "", data))
    return F.struct(*(c.alias(k) for k, c in decode_hex(h).items()))
