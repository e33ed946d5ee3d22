"""Problem 4: detection on fixtures, round trips of the permutations, untouched text."""

import random
from datetime import date

import pytest

from lexloom.llm import feistel, formats, pii

KEY = b"test key"
NAMES = pii.Names(frozenset({"tobias", "klara", "will", "hope"}), frozenset({"salmerida", "o'brannock", "vosskamp"}), frozenset({"will", "hope"}), frozenset({"oakfen"}), frozenset({"grace"}))


def kinds(text, field="text"):
    return [(k, text[a:b]) for k, a, b in pii.find(text, NAMES, field)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to a.b+c@mail-x.example, now", [("email", "a.b+c@mail-x.example")]),
        ("ask bob (at) host (dot) test or x[at]y.test", [("email", "bob (at) host (dot) test"), ("email", "x[at]y.test")]),
        ("call +44 (0)7700 900 305! or (415) 555-0142.", [("phone", "+44 (0)7700 900 305"), ("phone", "(415) 555-0142")]),
        ("07700 900343 030/23125-766 01.99.00.29.50", [("phone", "07700 900343"), ("phone", "030/23125-766"), ("phone", "01.99.00.29.50")]),
        ("ring five five five oh one four oh or knock", [("phone", "five five five oh one four oh")]),
        ("ssn 953-58-7091 and QQ 83 42 58 B, dni 00018144-G", [("id_number", "953-58-7091"), ("id_number", "QQ 83 42 58 B"), ("id_number", "00018144-G")]),
        ("at 48 Old Saltmarsh St. or 15, oakfen street", [("street", "48 Old Saltmarsh St"), ("street", "15, oakfen street")]),
        ("Larchmerestraße 22, calle Oakfen 196, 124 rue Thistledown", [("street", "Larchmerestraße 22"), ("street", "calle Oakfen 196"), ("street", "124 rue Thistledown")]),
        ("Dr. Tobias A. Salmerida and Vosskamp, Klara and T. Salmerida", [("name", "Tobias A. Salmerida"), ("name", "Vosskamp, Klara"), ("name", "T. Salmerida")]),
        ("my friend grace salmerida; WILL O'BRANNOCK", [("name", "grace salmerida"), ("name", "WILL O'BRANNOCK")]),
        ("Will survive, hope so; order 48-2291-07, ping 192.0.2.21, size 12-14-16, 978-0-00-000000-2, 4006 381 333", []),
        ("about 12 Street cats, 42 lane markers, met Salmerida at @klara", []),
        ("", []),
    ],
)
def test_find(text, want):
    assert kinds(text) == want


def test_altered_characters_give_exact_pieces():
    t = "mail bоb@mаil.test c​all ＋44 20 7946 0539"
    assert kinds(t) == [("email", "bоb@mаil.test"), ("phone", "＋44 20 7946 0539")]


def test_screen_names():
    for s, k in (("KlaraSalmerida", "name"), ("vosskamp.klara", "name"), ("2125550115", "phone"), ("a9@b.test", "email"), ("wildTheotter", None), (None, None)):
        assert kinds(s, "screen_name") == ([(k, s)] if k else []) if s else pii.find(s, NAMES, "screen_name") == []


def test_redaction_links_equal_values_and_keeps_the_rest():
    a, b = "Tel 07700 900343 now", "again 07700 900343!"
    ra, rb = pii.redact_text(a, NAMES, KEY), pii.redact_text(b, NAMES, KEY)
    assert ra.startswith("Tel [PHONE ") and ra.endswith("] now") and ra[4:-4] == rb[6:-1] and "900343" not in ra
    assert pii.redact_text(None, NAMES, KEY) is None and pii.redact_text("nothing here", NAMES, KEY) == "nothing here"


def test_permutations_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice("0123456789ABCXYZabc -./()") for _ in range(rng.randrange(0, 24)))
        p = feistel.permute_text(s, KEY)
        assert feistel.permute_text(p, KEY, back=True) == s and len(p) == len(s)
        assert all((x.isdigit(), x.isupper(), x.islower()) == (y.isdigit(), y.isupper(), y.islower()) for x, y in zip(s, p))
    assert len({feistel.permute_text(f"{i:03d}", KEY) for i in range(1000)}) == 1000
    assert feistel.permute_text("12-34", KEY).replace("-", "") == feistel.permute_text("1234", KEY)
    for d in (date(1900, 1, 1), date(2015, 2, 28), date(2099, 12, 31)):
        assert feistel.permute_date(feistel.permute_date(d, KEY), KEY, back=True) == d
    with pytest.raises(ValueError):
        feistel.permute_date(date(1899, 1, 1), KEY)


def test_names_are_learnt(spark):
    given, family = ["Tobias", "Klara", "Omar", "Will"], ["Vosskamp", "Rundqvar"]
    texts = [f"met {g} Newby at the bakery" for g in given[:3]] + [f"thanks to Zelda {f} again" for f in family] + [f"{g} {f} called" for g in given[:3] for f in family]
    texts += ["will survive the score"] * 20 + ["rose petals", None, ""]
    d = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, screen_name string")
    n = spark.createDataFrame([(g, "given") for g in [*given, "Rose"]] + [(f, "family") for f in family] + [(None, "given")], "name string, kind string")
    names = pii.learn_names(d, n)
    assert "newby" in names.family and "zelda" in names.given and "will" in names.common and "survive" not in names.family and "petals" not in names.family
    done = pii.protect(d, names, KEY)
    got = {tuple(r) for r in pii.pieces(done).collect()}
    assert (0, "text", "name", "Tobias Newby") in got
    assert pii.pieces(pii.protect(d.filter("false"), names, KEY)).count() == 0
    out = done.orderBy("doc_id").collect()
    assert len(out) == len(texts) and out[0].text.startswith("met [NAME ") and out[-1].text == "" and out[-2].text is None
    assert pii.learn_names(d.filter("false"), n.filter("false")) == pii.Names(*[frozenset()] * 5)


def test_long_lists_are_joined(spark, monkeypatch):
    texts = ["met Tobias Salmerida and T. Vosskamp", "Vosskamp, Klara wrote to bob@host.test", "nothing", None, "", "Tobias Salmerida again"]
    d = spark.createDataFrame([(i, t, ["klaravosskamp", None, "TobiasSalmerida"][i % 3], i) for i, t in enumerate(texts)], "doc_id long, text string, screen_name string, word int")
    n = spark.createDataFrame([("Tobias", "given"), ("Klara", "given"), ("Salmerida", "family"), ("Vosskamp", "family")], "name string, kind string")
    few = pii.protect(d, pii.learn_names(d, n), KEY)
    assert pii.protect(d.withColumnRenamed("word", "pieces"), pii.learn_names(d, n), KEY).columns == ["doc_id", "text", "screen_name", "pieces"]
    monkeypatch.setattr(pii, "MAX_WORDS", 0)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    known = pii.learn_names(d, n)
    many = pii.protect(d, known, KEY)
    assert many.columns == few.columns == ["doc_id", "text", "screen_name", "word", "pieces"]
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and pii.pieces(many).count() == 9


def test_pseudonyms_stay_valid():
    rng = random.Random(7)
    samples = [("phone", "+49 30 1234567"), ("phone", "(415) 555-0142"), ("phone", "001-617-555-0171"), ("phone", "0044 20 7946 0123"), ("phone", "07700 900343"), ("id_number", "123-45-6789"), ("id_number", "AB 12 34 56 C"), ("id_number", "12345678Z"), ("id_number", "x-1234567-l"), ("id_number", "1 84 12 76 451 089 46")]
    for kind, p in samples:
        assert formats.is_valid(kind, p), p
        for _ in range(40):
            key = rng.randbytes(8)
            q = formats.pseudonym(kind, p, key)
            assert formats.is_valid(kind, q) and formats.pseudonym(kind, q, key, back=True) == p and len(q) == len(p)
            assert all(x.isdigit() == y.isdigit() and x.islower() == y.islower() for x, y in zip(p, q))
    assert formats.pseudonym("phone", "+49 30 1234567", KEY).startswith("+49 ")
    for kind, p in (("id_number", "953-00-7091"), ("id_number", "00018144-A"), ("id_number", "9 80 13 99 386 192 61"), ("id_number", "QQ 83 42 58 B"), ("phone", "+83 1234567890")):
        q = formats.pseudonym(kind, p, KEY)
        assert not formats.is_valid(kind, p) and not formats.is_valid(kind, q) and formats.pseudonym(kind, q, KEY, back=True) == p
    q = formats.pseudonym("phone", "five five-five oh one four oh", KEY)
    assert formats.pseudonym("phone", q, KEY, back=True) == "five five-five oh one four oh" and q.count("-") == 1
    assert len({formats.pseudonym("phone", f"212-555-01{i:02d}", KEY) for i in range(100)}) == 100  # a permutation
    same = [formats.pseudonym("phone", p, KEY) for p in ("212-555-0101", "(212) 555 0101")]
    assert formats.compact(same[0]) == formats.compact(same[1])
    assert formats.calling_code("441") == 2 and formats.calling_code("1212") == 1 and formats.calling_code("3591") == 3 and formats.calling_code("831") == 0


def test_dates_on_request():
    t = "born 1987-03-12, call +44 20 7946 0123 by 2015-02-30"
    out, got = pii.protect_text(t, NAMES, KEY, dates=True)
    assert [g["kind"] for g in got] == ["date", "phone"] and out.startswith("born [DATE ") and "2015-02-30" in out
    new = date.fromisoformat(got[0]["placeholder"][6:-1])
    assert feistel.permute_date(new, KEY, back=True) == date(1987, 3, 12)
    assert "1987-03-12" in pii.redact_text(t, NAMES, KEY)
