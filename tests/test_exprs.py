"""Scalar expressions and the payload decoder against small golden tables."""

import base64
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterglass.functions import exprs as X
from meterglass.functions.phy import FIELDS, decode_base64

GOLDEN = {
    "401926012600050001AABBCCDD11223344": {"PHYPayloadLen": 34, "MIC": "11223344", "MHDR": "40", "DevAddr": "26012619", "FCtrl": "00", "FCnt": "0005", "FOpts": "", "FPort": "01"},
    "4019260126820500030701AABB11223344": {"PHYPayloadLen": 34, "MIC": "11223344", "MHDR": "40", "DevAddr": "26012619", "FCtrl": "82", "FCnt": "0005", "FOpts": "0307", "FPort": "01"},
    "0001020304050607081112131415161718ABCDDEADBEEF": {"PHYPayloadLen": 46, "MIC": "DEADBEEF", "MHDR": "00", "AppEUI": "0807060504030201", "DevEUI": "1817161514131211", "DevNonce": "CDAB"},
    "2001020304050619260126030100112233445566778899AABBCCDDEE00DEADBEEF": {"PHYPayloadLen": 66, "MIC": "DEADBEEF", "MHDR": "20", "AppNonce": "030201", "DevAddr": "26012619", "DLSettings": "03", "RxDelay": "01", "CFListType": "00", "CFList": "00112233445566778899AABBCCDDEE"},
    "4001AABBCC": {"PHYPayloadLen": 10},
    "40AA11223344": {"PHYPayloadLen": 12, "MIC": "11223344", "MHDR": "40", "DevAddr": "AA", "FCtrl": "", "FCnt": "", "FOpts": "", "FPort": ""},
    "E0192601260001000155667788": {"PHYPayloadLen": 26, "MIC": "55667788", "MHDR": "E0", "DevAddr": "26012619", "FCtrl": "00", "FCnt": "0001", "FOpts": "", "FPort": "01"},
}


def one(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_payload_decoder(spark):
    data = [base64.b64encode(bytes.fromhex(h)).decode() for h in GOLDEN] + [None, ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v string")
    rows = df.select("i", decode_base64(F.col("v")).alias("p")).orderBy("i").collect()
    for row, want in zip(rows, [*GOLDEN.values(), {}, {}], strict=True):
        assert row.p.asDict() == {n: want.get(n) for n in FIELDS}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_hex_to_decimal(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    given = ["FF", "26012619", "F" * 16, "4B3B4CA85A86C47A098A223FFFFFFFFF", "4B3B4CA85A86C47A098A224000000000", "F" * 32, "zz", "", None, "0" * 40, "0" * 20 + "a"]
    want = [255, 637609497, 18446744073709551615, 10**38 - 1, -1, -1, -1, None, None, 0, 10]
    assert one(spark, given, "string", X.hex_to_decimal) == [None if w is None else Decimal(w) for w in want]
    spark.conf.set("spark.sql.ansi.enabled", "true")


def test_fractions(spark):
    given = ["4/5", "OFF", "4/0", None, "4/5/6", " 3 / 4 ", "99999999999/1"]
    assert one(spark, given, "string", X.fraction_to_double) == [0.8, -1.0, -1.0, None, -1.0, 0.75, -1.0]
    assert one(spark, given, "string", lambda c: X.fraction_to_double(c, "null")) == [0.8, None, None, None, None, 0.75, None]


def test_octets_and_rates(spark):
    assert one(spark, ["26012619", "", None, "ABC"], "string", X.reverse_octets) == ["19260126", "", None, "CAB"]
    given = ["SF7BW125", "FSK", "", None]
    assert one(spark, given, "string", lambda c: X.data_rate(c)[0]) == [7, -1, -1, None]
    assert one(spark, given, "string", lambda c: X.data_rate(c)[1]) == [125, -1, -1, None]


def test_channel_list_and_json(spark):
    given = ["00112200", "", None]
    assert one(spark, given, "string", lambda c: X.cflist_split(c)[0]) == ["001122", None, None]
    assert one(spark, given, "string", lambda c: X.cflist_split(c)[1]) == ["00", None, None]
    assert one(spark, ['\x02hd{"rxpk":[]}', '{"stat":{}}\nx', "no", None], "string", X.json_tail) == ['{"rxpk":[]}', '{"stat":{}}', "", None]


def test_signal_merge(spark):
    rows = [(1, [1, 2, None]), (None, [3]), (None, None)]
    df = spark.createDataFrame(rows, "own bigint, others array<bigint>")
    got = df.select(X.distinct_values(F.col("own"), F.col("others")).alias("v")).select(X.pick(F.col("v"), 0), X.pick(F.col("v"), 1)).collect()
    assert [tuple(r) for r in got] == [(1, 2), (3, None), (None, None)]


@pytest.mark.parametrize(("seconds", "text"), [(0.5, "500 ms"), (0.99999, "1 s"), (61, "1 min 1 s"), (3600, "1 h"), (3661, "1 h 1 min 1 s")])
def test_durations(seconds, text):
    assert X.duration_text(seconds) == text
