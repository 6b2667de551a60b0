import hashlib
import math
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.llm import pii

KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow(text):
    out = []
    for kind, pattern in KINDS:
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]
            if good():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = [
    None, "", "nothing here", "a@b.c", "a@b", "a@@b.c", "x.y+z%1@mail-1.example.com.", "a@b.c_d@e.f g@h.i", "é\U0001f600 a.b@c.de 1.2.3.4",
    "a@b@c.d", "@b.c", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.0.1 000.0.0.0 1.2.3", "1.2.3.400 1.2.3.4", "9" * 400 + ".1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111 1111 1111", "0" * 13, "0" * 19, "0" * 20, "4111111111111111 4111111111111111",
    "+1 (743) 555-3824", "+1 (743) 555-3824 +49.30.123456", "+12", "+1 2", "+1234567", "+12345678", "+1 23456789012345", "+1 234567890123456", "++1 234 567 89)",
    "4465758382889437 +1 (663) 555-6869 it.19@mail5.example.com 8.196.197.208", "a." * 3000 + "@b" + ".c" * 3000, "x" * 20000 + "@", "1 " * 9000, "+1" + " " * 5000 + "2",
    "\n".join(f"u{i}@h{i}.example.com {i % 256}.1.2.3 +1 555 000 {i:04d}" for i in range(700)),
]


def spans(df):
    found = pii.personal_data(df)
    base = F.array_join(pii.digest(F.col("base")), ",")
    return [(r.doc_id, r.b) for r in found.select("doc_id", base.alias("b")).collect()]


def test_base_spans_against_plain_patterns(spark):
    rows = list(enumerate(TEXTS))
    got = dict(spans(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, text in rows:
        assert got[i] == slow(text), repr(text)[:80]


def test_random_texts(spark):
    rng = random.Random(3)
    alphabet = "0123456789.+-@ ()ab%_é"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(120))) for i in range(400)]
    got = dict(spans(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[i] == slow(t) for i, t in rows)


def leaks():
    """Mail boxes that one code word gives away, in different contexts; and common words."""
    rng = random.Random(1)
    fill = [f"filler{i}" for i in range(200)]
    words = lambda n: " ".join(rng.choice(fill) for _ in range(n))
    rows = []
    for i in range(6):
        rows.append((i, f"{words(5)} Bluebird {words(2)} ann@corp.example.com the {words(4)}"))
    rows += [(10 + i, f"bluebird the mailbox {words(6)} bob{i}@corp.example.com") for i in range(2)]
    rows += [(20 + i, "copied text redstart carol@corp.example.com the end") for i in range(9)]  # copies are one context
    rows += [(100 + i, f"{words(12)} the {words(12)}") for i in range(300)]
    rows += [(7, None), (8, "")]
    return rows


def test_terms_that_reveal_are_found(spark):
    df = spark.createDataFrame(leaks(), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert len(found) == len(leaks())
    for i in [*range(6), 10, 11]:  # the code word goes from every text that holds it
        text = dict(leaks())[i]
        own = {(text[s["start"] : s["end"]].lower(), s["action"]) for s in found[i]["added"]}
        assert own == {("bluebird", "remove")} or own == {("bluebird", "generalise")}
        assert len(found[i]["base"]) == 1
    assert not any(found[i]["added"] for i in found if i not in [*range(6), 10, 11])


def test_thresholds(spark):
    df = spark.createDataFrame(leaks(), "doc_id long, text string")
    none = pii.personal_data(df, generalise_at=1.5)
    assert none.filter(F.size("added") > 0).count() == 0
    copies = pii.personal_data(df, min_contexts=1).filter("doc_id = 20").first()
    assert copies["added"]


def test_against_sql(spark):
    rows = leaks() + [(1000 + i, t) for i, t in enumerate(TEXTS) if t is None or len(t) < 2000]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(pii.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    terms = F.transform("added", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    got = found.select("doc_id", F.array_join(F.concat(pii.digest(F.col("base")), terms), ",").alias("spans")).orderBy("doc_id").toPandas()
    assert "term:" in "".join(want.spans)
    assert got.spans.tolist() == want.spans.tolist()


def test_sanitise(spark):
    rows = [
        (1, "mail a.b@c.de and 1.2.3.4 or +1 (743) 555-3824, card 4111 1111 1111 1111!", 9, "x"), (2, "clean", 5, "y"), (None, None, None, "z"),
        (2, "clean", 5, "y"), (3, "+4222222222222 x 1.2.3.4", 3, "w"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string")
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = {(r.doc_id, r.base): r for r in out.collect()}
    assert out.count() == 5
    first = got[(1, "x")]
    assert first.text == "mail [EMAIL] and [IP] or [PHONE], card [CARD]!" and first.n_chars == len(first.text)
    assert got[(2, "y")].n_chars == 5 and got[(None, "z")].text is None
    assert got[(3, "w")].text == "[PHONE] x [IP]"  # the card number within the phone number too
    leaked = pii.sanitise(spark.createDataFrame(leaks(), "doc_id long, text string")).filter("doc_id < 6").collect()
    assert all("bluebird" not in r.text.lower() and "[EMAIL]" in r.text for r in leaked)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert pii.personal_data(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_query_digest(spark):
    row = pii.op3_pii(spark, "/root/testdata/sf0.001").filter("n_phone > 0 or n_email > 0").first()
    base = ",".join(s for s in row.spans.split(",") if not s.startswith("term"))
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    plan = pii.op3_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("text", ["a@b.c " * 3000])
def test_many_spans_in_one_text(spark, text):
    out = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out.text == "[EMAIL] " * 3000


def test_sanitise_takes_a_revealing_term_from_every_text(spark):
    far = "ann@corp.example.com " + "filler " * 40 + "Bluebird again"
    rows = leaks() + [(2000, "a bluebird alone, no address; BLUEBIRD!"), (2001, far), (2002, "bluebirds stay")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not [i for i, t in out.items() if re.search(r"\bbluebird\b", t or "", re.I)]
    assert out[2002] == "bluebirds stay" and out[7] is None and out[8] == ""
    found = {r.doc_id: r.added for r in pii.personal_data(df).collect()}
    text = dict(rows)
    assert [text[2000][s["start"] : s["end"]] for s in found[2000]] == ["bluebird", "BLUEBIRD"]
    assert [text[2001][s["start"] : s["end"]] for s in found[2001]] == ["Bluebird"]
    assert found[10] and found[11] and not found[100]


def test_a_term_reveals_entities_that_are_mentioned_once(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(f"filler{rng.randrange(200)}" for _ in range(n))
    rows = [(i, f"{words(5)} Kestrel {words(2)} u{i}@nest.example.org {words(4)}") for i in range(4)]
    rows += [(10 + i, f"{words(5)} Plover {words(2)} 10.20.30.{i} {words(4)}") for i in range(4)]
    rows += [(20 + i, f"{words(5)} Dunlin {words(2)} +1 743 555 000{i} {words(4)}") for i in range(4)]
    rows += [(30 + i, "one text Siskin u@copy.example.net") for i in range(5)] + [(100 + i, words(24)) for i in range(300)]
    out = {r.doc_id: r.text.lower() for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(w in t for t in out.values() for w in ("kestrel", "plover", "dunlin"))
    assert all("siskin" in out[30 + i] for i in range(5))  # copies of one text


def flags(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii._analysed(df, "text", ["doc_id"], pii.CONTEXT_CHARS)
    options = {"min_contexts": 3, "generalise_at": 0.8, "remove_at": 0.95} | options
    return {(r.e, r.t): (r.disclosure, r.action) for r in pii.revealing(found, **options).collect()}


def test_every_mention_counts_for_an_entity(spark):
    rows = [(i, f"word{i} zeta ann@corp.example.com") for i in range(4)] + [(9, "zeta alone")]
    rows += [(100 + i, "ann@corp.example.com") for i in range(100)] + [(300 + i, "filler") for i in range(200)]
    # 4 of the 5 rows with zeta mention her, and so do 104 of 305: 1 + log2(4 / 5) / log2(305 / 104).
    got = flags(spark, rows, generalise_at=0.7)
    assert got[("0:ann@corp.example.com", "zeta")][0] == pytest.approx(1 + math.log2(0.8) / math.log2(305 / 104))
    assert ("0:ann@corp.example.com", "zeta") not in flags(spark, rows, generalise_at=0.8)


def test_a_term_at_a_threshold_is_over_it(spark):
    # 2 of the 4 rows with zeta mention the address, which 2 of 32 rows do: 1 + log2(1 / 2) / log2(16) is 0.75.
    rows = [(i, f"word{i} zeta ann@corp.example.com") for i in range(2)] + [(10 + i, "zeta") for i in range(2)] + [(100 + i, None) for i in range(28)]
    pair = ("0:ann@corp.example.com", "zeta")
    assert flags(spark, rows, min_contexts=2, generalise_at=0.75)[pair] == (0.75, "generalise")
    assert flags(spark, rows, min_contexts=2, generalise_at=0.5, remove_at=0.75)[pair] == (0.75, "remove")
    assert pair not in flags(spark, rows, min_contexts=2, generalise_at=0.7500001)


def test_clashing_names(spark):
    rows = [(1, "x a@b.cd", 1, 2, 3, 4), (None, None, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "t long, row string, base int, k0 int, near int, added int")
    found = pii.personal_data(df, "t", "row")
    assert found.columns == ["t", "base", "added"] and {(r.t, len(r.base)) for r in found.collect()} == {(1, 1), (None, 0)}
    out = pii.sanitise(df, "t", "row", None)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x [EMAIL]", 1, 2, 3, 4), rows[1]], key=str)
