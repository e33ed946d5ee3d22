"""Problems 1 to 3 against brute force, and on odd input."""

import json
import shutil
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexloom.operators import corpus as C
from lexloom.operators import quarantine as QR
from lexloom.operators import redelivery as RD
from lexloom.operators import relationalize as RL
from lexloom.sources import tweets as J

LINES = [
    (1, '{"id_str":"1","entities":{"hashtags":[{"text":"a"},{"text":" "},{"text":"b","indices":[1,2]}]},"user":{"screen_name":"x","location":{"name":"L","codes":[1,2]}},"retweeted_status":{"id_str":"2","entities":{"hashtags":{"text":"lone"}},"retweeted_status":{"entities":{"hashtags":[{"text":"deep"}]}}}}'),
    (2, '{"id_str":3,"entities":null,"user":null,"retweeted_status":null}'),
    (3, '{"delete":{"status":{"id_str":"1"}}}'),
    (4, '{"id_str":"5"} trailing'),
    (5, "not json"),
    (6, None),
    (7, ""),
    (8, "[1]"),
    (9, '{"entities":{"hashtags":["bare",{"text":7}]},"weird key":{"a":1}}'),
    (1, '{"entities":{"hashtags":[{"text":"a"}]}}'),
]


def records(spark, rows):
    r = J.parse_records(spark.createDataFrame(rows, "line_no long, line string"))
    return r.filter(F.col("rec").isNotNull() & ~J.is_tombstone("rec")).drop("line")


def test_relations(spark):
    schema, t = RL.relationalize(records(spark, LINES), keep=("user",))
    assert schema.depth == 2 and {"entities_hashtags", "user", "user_location_codes", "entities_hashtags_indices"} <= set(schema.relations)
    tags = {(r.line_no, r.nest_level, r.ord_no, r.text) for r in t["entities_hashtags"].collect()}
    assert tags == {(1, 0, 0, "a"), (1, 0, 1, " "), (1, 0, 2, "b"), (1, 1, 0, "lone"), (1, 2, 0, "deep"), (9, 0, 0, None), (9, 0, 1, "7")}
    tw = {r.row_key: r.parent_key for r in t["tweet"].collect()}
    assert tw == {"1:0": None, "1:1": "1:0", "1:2": "1:1", "2:0": None, "9:0": None}
    assert [(r.parent_key, r.location_name) for r in t["user"].collect()] == [("1:0", "L")]
    assert sorted((r.parent_key, r.ord_no, r.value) for r in t["user_location_codes"].collect()) == [("1:0:0", 0, 1), ("1:0:0", 1, 2)]


def test_relations_of_nothing(spark):
    schema, t = RL.relationalize(records(spark, [(5, "x"), (6, None)]))
    assert list(t) == ["tweet"] and t["tweet"].count() == 0


def test_clashing_field_names(spark):
    _, t = RL.relationalize(records(spark, [(1, '{"line_no":5,"parent_key":"x","a":{"b":[{"ord_no":1,"node":2}]}}')]))
    r = t["tweet"].first()
    assert (r.line_no, r.line_no_, r.parent_key, r.parent_key_) == (1, 5, None, "x")
    assert t["a_b"].first().ord_no_ == 1


def test_shape_parser():
    assert RL.parse_shape("OBJECT<a: BIGINT, `b, c`: ARRAY<OBJECT<d: DECIMAL(3, 1)>>>") == ("object", {"a": "BIGINT", "b, c": ("array", ("object", {"d": "DECIMAL"}))})
    with pytest.raises(ValueError):
        RL.parse_shape("OBJECT<a: <")


def test_brute_force_hashtags(spark, data):
    from lexloom.plans.core_problems import Q

    want = set()
    for r in spark.read.parquet(f"{data}/raw_tweet.parquet").select("line_no", "line").collect():
        try:
            o = json.loads(r.line)
        except ValueError:
            continue
        if not isinstance(o, dict) or "delete" in o:
            continue
        level = 0
        while isinstance(o, dict):
            hs = (o.get("entities") or {}).get("hashtags") or []
            for k, h in enumerate(hs if isinstance(hs, list) else [hs]):
                if (h.get("text") or "").strip():
                    want.add((r.line_no, level, k, h["text"]))
            o, level = o.get("retweeted_status"), level + 1
    got = [tuple(r) for r in Q["p1_found"](spark, data).collect()]
    assert set(got) == want and len(got) == len(want)


def cells(line):
    """Field by field, as the rules say; None if the quoting fails."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, s = i + 1, ""
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                s += line[i:j]
                i = j + 1
                if line[i : i + 1] == '"':
                    s, i = s + '"', i + 1
                else:
                    break
            if i < len(line) and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            s, i = line[i:j], j
        out.append(s)
        if i >= len(line):
            return out
        i += 1


def reason(line):
    if line is None:
        return "columns"
    c = cells(line)
    if c is None:
        return "quoting"
    if len(c) != 8:
        return "columns"
    ok = re.fullmatch("[0-9]+", c[0]) and int(c[0]) > 0 and all(re.fullmatch("[0-9]+", x) for x in c[3:7]) and c[1].strip() and c[7].strip() and "�" not in c[7]
    try:
        datetime.strptime(c[2][4:], "%b %d %H:%M:%S %z %Y")
        ok = ok and re.fullmatch(r"[A-Z][a-z]{2} [A-Z][a-z]{2} \d\d \d\d:\d\d:\d\d [+-]\d{4} \d{4}", c[2])
    except ValueError:
        ok = False
    return None if ok else "value"


GOOD = "7\tbob\tThu Jan 01 00:00:00 +0000 2015\t1\t2\t3\t4\t"
ODD = [
    GOOD + "hello", GOOD + '"a\tb ""c"""', GOOD + '"open', GOOD + '"x"y', GOOD + 'say "hi"', GOOD + "", GOOD + "a\tb", "", None, "\t" * 7,
    GOOD.replace("Jan 01", "Feb 30") + "x", GOOD.replace("7\t", "0\t", 1) + "x", GOOD.replace("\t1\t", "\t-1\t") + "x", GOOD + "bad � char", GOOD + '"' + 'q""' * 30_000 + '"', GOOD + "line\nbreak", GOOD + "hello",
]


def test_quarantine(spark):
    df = spark.createDataFrame([(i if i != 3 else None, s, "other") for i, s in enumerate(ODD)], "line_no long, line string, reason string")
    rules = QR.rule_table(spark)
    got = {r.line_no: r.reason for r in QR.failing(df, rules).collect()}
    assert got == {(i if i != 3 else None): reason(s) for i, s in enumerate(ODD) if reason(s)}
    ok = {r.line_no: r.text for r in QR.clean(df, rules).collect()}
    assert set(ok) == {i for i, s in enumerate(ODD) if not reason(s)} and ok[1] == 'a\tb "c"'
    assert QR.failing(df.filter("false"), rules).count() == 0


def test_quarantine_brute_force(spark, data):
    from lexloom.plans.core_problems import Q

    want = {r.line_no: reason(r.line) for r in spark.read.parquet(f"{data}/extract_line.parquet").collect()}
    got = {r.line_no: r.reason for r in Q["p2_found"](spark, data).collect()}
    assert got == {k: v for k, v in want.items() if v}


MSG = "id string, received_at timestamp, line_no long, batch_id int"


def at(day):
    return datetime(2015, 1 + day // 28, 1 + day % 28)


def test_store(spark, tmp_path):
    store = RD.MessageStore(spark, f"file://{tmp_path}/store")
    first = [("a", at(40), 1, 1), ("b", at(2), 2, 1), ("c", at(70), 3, 1), (None, at(1), 4, 1), ("b", at(2), 5, 1)]
    store.merge(spark.createDataFrame(first, MSG))
    before = store._manifest()[1]
    out = store.merge(spark.createDataFrame([("a", at(3), 6, 2), ("d", at(71), 7, 2), ("c", None, 8, 2), ("b", at(2), 9, 2)], MSG))
    assert {(r.id, r.line_no) for r in store.read().collect()} == {("a", 6), ("b", 2), ("c", 3), ("d", 7)}
    assert set(out["rewritten"]) == {"2015-01", "2015-02", "2015-03"}
    out = store.merge(spark.createDataFrame([("e", at(5), 10, 3)], MSG))
    assert out["rewritten"] == [] and out["extended"] == ["2015-01"] and out["kept"] == ["2015-03"]
    with pytest.raises(Exception):  # a second commit of the same version is refused
        store._commit(1, before)
    assert store.vacuum() > 0 and store.read().count() == 5
    store.merge(spark.createDataFrame([], MSG))
    assert store.read().count() == 5


def test_merge_reads_only_the_buckets_it_needs(spark, tmp_path):
    store = RD.MessageStore(spark, f"file://{tmp_path}/store", buckets=8)
    store.merge(spark.createDataFrame([(f"i{k}", at(k % 90), k, 1) for k in range(200)], MSG))
    again = spark.createDataFrame([("i7", at(1), 900, 2)], MSG)
    mine = again.select(RD.bucket(8)).first()[0]
    for p in (tmp_path / "store" / "index").glob("v*/bucket=*"):
        if p.name != f"bucket={mine}":
            shutil.rmtree(p)
    assert store.merge(again)["rewritten"] == ["2015-01"]
    assert store.read().count() == 200 and store.read().filter("id = 'i7'").first().line_no == 900


def test_redelivery_brute_force(spark, data):
    from lexloom.plans.core_problems import Q

    seen, drop = {}, set()
    rows = spark.read.parquet(f"{data}/raw_tweet.parquet").collect()
    for r in sorted(rows, key=lambda r: (r.received_at, r.line_no)):
        try:
            o = json.loads(r.line)
        except ValueError:
            continue
        if not isinstance(o, dict) or "delete" in o or o.get("id_str") is None:
            continue
        k = str(o["id_str"]).strip()
        if k:
            drop |= {r.line_no} if k in seen else set()
            seen[k] = 1
    assert {r.line_no for r in Q["p3_found"](spark, data).collect()} == drop


def test_hot_identifier(spark):
    """One identifier with a third of all rows is reduced before the shuffle."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.timestamp_seconds("id").alias("received_at"), F.col("id").alias("line_no"))
    assert RD.winners(df).filter("id = 'hot'").first().line_no == 0


def test_corpus_odd_rows(spark):
    lines = spark.createDataFrame([(s,) for _, s in LINES], "line string")
    stats = {r.category: r.n for r in C.basic_stats(lines).collect()}
    assert stats["Total_Rows"] == len(LINES) and stats["Deleted"] == 1 and stats["Unable_to_parse"] == 5
    assert C.basic_stats(lines.filter("false")).collect()[0].n == 0
    assert C.english_records(lines).count() == 0
    df = spark.createDataFrame([(None, "x y"), (1, None), (1, "a b c d"), (2, "")], "id long, text string")
    assert C.first_per_key(df, "id", ["text"]).count() == 2
    assert C.remove_low_freq(df, "id", "text", 1).count() == 1


def _lines(spark, *objects):
    return records(spark, [(i, json.dumps(o)) for i, o in enumerate(objects)])


def test_shared_element_gets_one_table(spark):
    point = {"lat": 1.5, "lon": 2.5, "name": "x"}
    schema, t = RL.relationalize(_lines(spark, {"id": 1, "home": {"geo": point, "street": "s"}, "place": {"geo": {"lat": 3.5, "lon": 4.5}}}, {"id": 2, "origin": point, "tags": [{"geo": point, "n": 1}]}))
    assert set(schema.relations) == {"tweet", "origin", "tags"}
    rows = sorted((r.parent_key, r.parent_table, r.parent_path, r.lat) for r in t["origin"].collect())
    assert rows == [("0:0", "tweet", "home.geo", 1.5), ("0:0", "tweet", "place.geo", 3.5), ("1:0", "tweet", "origin", 1.5), ("1:0:0", "tags", "geo", 1.5)]
    assert len({r.row_key for r in t["origin"].collect()}) == 4
    assert "home_street" in t["tweet"].columns  # a singleton descendant is inlined


def test_several_recursive_keys(spark):
    def post(i, **kw):
        return {"id_str": str(i), "text": f"t{i}", "lang": "en", "tags": [{"text": f"h{i}"}]} | kw

    objects = [post(1, quoted_status=post(2, retweeted_status=post(3)), retweeted_status=post(4, quoted_status=post(5, quoted_status=post(6)))), post(7), post(8, replies=[post(9), post(10, replies=[post(11)])])]
    schema, t = RL.relationalize(_lines(spark, *objects))
    assert set(schema.relations) == {"tweet", "tags"} and schema.depth == 3

    def brute(o, up):
        got = {(o["id_str"], up)}
        for k in ("quoted_status", "retweeted_status"):
            got |= brute(o[k], o["id_str"]) if k in o else set()
        return got.union(*[brute(x, o["id_str"]) for x in o.get("replies", [])])

    rows = t["tweet"].collect()
    ids = {r.row_key: r.id_str for r in rows}
    assert len(ids) == len(rows) == 11
    assert {(r.id_str, ids.get(r.parent_key)) for r in rows} == set().union(*[brute(o, None) for o in objects])
    assert {(ids[r.parent_key], r.text) for r in t["tags"].collect()} == {(str(i), f"h{i}") for i in range(1, 12)}


def test_recursion_below_the_root(spark):
    c = lambda i, *r: {"author": i, "body": "b", "score": 1, "answers": list(r)}
    schema, t = RL.relationalize(_lines(spark, {"title": "x", "comments": [c(1, c(2), c(3, c(4))), c(5)]}, {"title": "y"}))
    assert set(schema.relations) == {"tweet", "comments"}
    rows = t["comments"].collect()
    who = {r.row_key: r.author for r in rows}
    assert {(r.author, who.get(r.parent_key), r.parent_table) for r in rows} == {(1, None, "tweet"), (5, None, "tweet"), (2, 1, "comments"), (3, 1, "comments"), (4, 3, "comments")}


def test_recursion_through_another_table_is_refused(spark):
    u = {"name": "n", "pinned": {"id_str": "2", "text": "t", "lang": "x"}}
    with pytest.raises(ValueError, match="recursion"):
        RL.relationalize(_lines(spark, {"id_str": "1", "text": "t", "lang": "x", "user": u}), keep=("user",))
    assert RL.relationalize(_lines(spark, {"id_str": "1", "text": "t", "lang": "x", "user": u}))[1]["tweet"].count() == 2
