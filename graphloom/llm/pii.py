"""Information-theoretic sanitisation with DataFrame functions only.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. A term
near an entity reveals it as far as it shares the entity's information content,

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 + log2 P(e | t) / log2 (N / n(e)),

with counts of rows over the whole corpus: ``n(e)`` mention the entity, ``n(t)`` hold the term,
``n(t, e)`` do both. A pair is estimated if the term was seen within ``context_chars`` of the
entity in at least ``min_contexts`` different contexts, so that copies of one text prove
nothing. As most values are mentioned too seldom for that, each value's class (an address'
domain, a network, a number's prefix) is an entity too; there different texts count as contexts.
A term is generalised from one threshold on and removed from another, wherever it occurs in any
text. Base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.batches import quoted
from graphloom.llm.storage import cut, written

KINDS = ("email", "ip", "card", "phone")
CONTEXT_CHARS, MIN_CONTEXTS, GENERALISE_AT, REMOVE_AT = 80, 3, 0.8, 0.95

#: The base patterns with possessive repeats and anchors that skip starts which cannot match:
#: the same leftmost matches in linear time and constant stack, whatever the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of the kind holds, for a quick look first.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK, CHUNK = 256, 4096
#: A private-use character that stands for a protected one; it counts as part of a word.
MASK = "\ue000"
#: Rows, once counted, that may be broadcast: terms, which are words near an entity, numbers, or a text's places.
BROADCAST_ROWS = 200_000

SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    digits = F.split(F.reverse(_digits(x)), "")
    twice = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(digits, lambda d, i: twice(d.cast("int"), i)), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return x.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    need = NEEDS[kind]
    return F.when(F.contains(text, F.lit(need)), found) if need else found


def _places(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start,end,value>> of ``found``, the matches of ``pattern`` in ``text``.

    Offsets are running sums of the lengths between and of the matches, in blocks, so that the
    arrays that grow step by step stay short.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), lambda s: s["m"].isNotNull())
    last = F.floor((F.size(found) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(steps, i * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + s["gap"] + F.length(s["m"])))
    firsts = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def block(b: Column, first: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            start = a["pos"] + s["gap"]
            span = F.struct(start.alias("start"), (start + F.length(s["m"])).alias("end"), s["m"].alias("value"))
            return F.struct((start + F.length(s["m"])).alias("pos"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(b, F.struct(first.alias("pos"), none.alias("out")), step, lambda a: a["out"])

    return F.flatten(F.zip_with(blocks, F.slice(firsts, 1, F.size(blocks)), block))


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` and a column ``base``: array<struct<kind,start,end,value>> by kind, then start.

    A null or empty text has an empty array.
    """
    for kind in KINDS:
        df = df.withColumn(f"_m_{kind}", _found(F.col(text), kind))
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def spans(i: int, kind: str) -> Column:
        found = F.col(f"_m_{kind}")
        placed = F.filter(_places(F.col(text), PATTERNS[kind], found), lambda s: _valid(kind, s["value"]))
        named = F.transform(placed, lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, named).otherwise(none)

    parts = [spans(i, kind) for i, kind in enumerate(KINDS)]
    return df.withColumn("base", F.concat(*parts)).drop(*[f"_m_{kind}" for kind in KINDS])


def _chunks(text: Column) -> Column:
    """``text`` in parts of CHUNK code points, so that a cut from it does not scan it from the start."""
    last = F.floor((F.length(text) - 1) / CHUNK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.length(text) > 0, parts).otherwise(F.expr("cast(array() as array<string>)"))


def _cut(chunks: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start``, CHUNK at most."""
    at = F.floor(start / CHUNK).cast("int")
    two = F.concat(F.coalesce(F.get(chunks, at), F.lit("")), F.coalesce(F.get(chunks, at + 1), F.lit("")))
    return F.substring(two, start - at * CHUNK + 1, length)


def _rewritten(chunks: Column, marks: Column, put) -> Column:
    """``chunks`` with ``put(own, mark, first)`` in place of marked text; ``marks`` are sorted by start.

    ``own`` is what of the mark is in this chunk and in no earlier mark; ``first`` says that the
    mark starts here, outside any earlier one.
    """

    def chunk(c: Column, i: Column) -> Column:
        low, high = i * CHUNK, (i + 1) * CHUNK

        def step(a: Column, m: Column) -> Column:
            start = F.greatest(m["start"], a["pos"])
            stop = F.greatest(F.least(m["end"], high), a["pos"])
            gap = F.substring(c, a["pos"] - low + 1, start - a["pos"])
            own = F.substring(c, start - low + 1, stop - start)
            first = (m["start"] >= low) & (m["start"] >= a["pos"])
            return F.struct(stop.alias("pos"), F.concat(a["out"], gap, put(own, m, first)).alias("out"))

        near = F.filter(marks, lambda m: (m["start"] < high) & (m["end"] > low))
        start = F.struct(low.alias("pos"), F.lit("").alias("out"))
        return F.aggregate(near, start, step, lambda a: F.concat(a["out"], F.substring(c, a["pos"] - low + 1, F.lit(CHUNK))))

    return F.transform(chunks, chunk)


def _masked(chunks: Column, base: Column) -> Column:
    """``chunks`` of the same length in which base spans have MASK for each character of a word."""
    marks = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return _rewritten(chunks, marks, lambda own, m, first: F.regexp_replace(own, WORD[:-1], MASK))


def _context(chunks: Column, masked: Column, base: Column, chars: int) -> Column:
    """array<struct<e,t,c>>: the words near each base span that touch none, and a hash of the text around it.

    A word that the window's outer edge may have cut is left out.
    """

    def near(span: Column) -> Column:
        first = F.greatest(span["start"] - chars, F.lit(0))
        size = span["start"] - first
        context = F.xxhash64(_cut(chunks, first, size), _cut(chunks, span["end"], F.lit(chars)))
        left, right = _cut(masked, first, size), _cut(masked, span["end"], F.lit(chars))
        left = F.when(first > 0, F.regexp_replace(left, f"^{WORD}", "")).otherwise(left)
        right = F.when(F.length(right) == chars, F.regexp_replace(right, f"{WORD}$", "")).otherwise(right)
        words = F.filter(_words(F.concat(left, F.lit(" "), right)), lambda w: ~F.contains(w, F.lit(MASK)))
        return F.transform(words, lambda w: F.struct(_entity(span).alias("e"), w.alias("t"), context.alias("c")))

    return F.flatten(F.transform(base, near))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"].cast("string"), F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"])))


def _class(e: Column) -> Column:
    """The class of an entity: e-mail domain, 24-bit network, first six card digits, all but a phone's last four."""
    kind, value = F.substring(e, 1, 1), F.substring(e, 3, F.length(e))
    name = (
        F.when(kind == "0", F.regexp_replace(value, "^[^@]*", ""))
        .when(kind == "1", F.regexp_replace(value, "[0-9]+$", ""))
        .when(kind == "2", F.substring(value, 1, 6))
        .otherwise(F.substring(value, F.lit(1), F.length(value) - 4))
    )
    return F.concat_ws(":", F.lit("class"), kind, name)


def _words(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), GAP)), "")


def _analysed(df: DataFrame, text_col: str, keep: list[str], context_chars: int) -> DataFrame:
    """Stored rows (row, t, k0.., h, base, near, keys): the text, ``keep``, its hash, spans, context words and entities.

    The patterns run over each text once; what follows reads only the columns that it needs.
    """
    if not 0 < context_chars <= CHUNK:
        raise ValueError(f"a context has 1 to {CHUNK} characters")
    kept = [F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = base_spans(df.select(F.col(quoted(text_col)).cast("string").alias("t"), *kept), "t")
    some = F.size("base") > 0
    rows = rows.withColumn("chunks", F.when(some, _chunks(F.col("t"))))
    rows = rows.withColumn("masked", F.when(some, _masked(F.col("chunks"), F.col("base"))))
    near = F.when(some, _context(F.col("chunks"), F.col("masked"), F.col("base"), context_chars))
    keys = F.transform("base", _entity)
    keys = F.when(some, F.array_distinct(F.concat(keys, F.transform(keys, _class))))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "t", *[f"k{i}" for i in range(len(keep))],
        F.xxhash64("t").alias("h"), "base", near.alias("near"), keys.alias("keys"))
    return written(rows, "personal_data")


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` to broadcast, if there are no more than BROADCAST_ROWS; else as they are. None at all end the plan here."""
    n = rows.count()
    return rows.limit(0) if not n else F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _disclosure(n_te: Column, total: int) -> Column:
    share = F.log2(F.least(n_te / F.col("n_t"), F.lit(1.0)))
    return F.when(F.col("n_e") < total, 1 + share / F.log2(F.lit(float(total)) / F.col("n_e"))).otherwise(0.0)


def revealing(found: DataFrame, min_contexts: int, generalise_at: float, remove_at: float) -> DataFrame:
    """(e, t, disclosure, action) of the terms over the thresholds, a term at one being over it.

    Everything is counted over the whole corpus with map-side partial aggregates: no list of a
    term's or an entity's rows is ever made. The words of all texts are counted before they meet
    the pairs. ``n(t, e)`` is at most the lesser of ``n(t)`` and ``n(e)``; pairs that do not pass
    with that are dropped, and the rows of the others counted.
    """
    total = found.count()
    mine = F.transform("near", lambda w: F.struct(_class(w["e"]).alias("e"), w["t"].alias("t"), F.col("h").alias("c")))
    pairs = found.filter("near is not null").select(F.explode(F.array_distinct(F.concat("near", mine))).alias("p")).select("p.e", "p.t", "p.c")
    seen = pairs.groupBy("e", "t").agg(F.count_distinct("c").alias("contexts")).filter(F.col("contexts") >= min_contexts)
    n_e = found.select(F.explode("keys").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    n_t = found.select(F.explode(_words(F.col("t"))).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    known = seen.select("e", "t").join(n_e, "e").join(n_t, "t")
    likely = cut(known.filter(_disclosure(F.least("n_e", "n_t"), total) >= generalise_at))
    terms = _few(likely.select("t").distinct())
    held = found.filter("keys is not null").select("keys", F.explode(_words(F.col("t"))).alias("t")).join(terms, "t")
    held = held.select("t", F.explode("keys").alias("e")).groupBy("e", "t").agg(F.count("*").alias("n_te"))
    flagged = likely.join(held, ["e", "t"]).withColumn("disclosure", _disclosure(F.col("n_te"), total))
    action = F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise")
    return flagged.filter(F.col("disclosure") >= generalise_at).select("e", "t", "disclosure", action.alias("action"))


def _added(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """(row, added) of the texts that hold a flagged term: its places that touch no base span.

    Only those texts are split into words with their places, which are running sums over a text.
    """
    terms = _few(cut(flagged.groupBy("t").agg(F.max("action").alias("action"))))
    hits = cut(found.select("row", F.explode(_words(F.col("t"))).alias("t")).join(terms, "t").select("row").distinct())
    texts = found.join(_few(hits), "row", "left_semi").select("row", "t", "base")
    words = F.filter(F.split("t", GAP), lambda w: w != "")
    gaps = F.transform(F.split("t", WORD, -1), F.length)
    steps = texts.select("row", F.posexplode(F.arrays_zip(gaps.alias("gap"), words.alias("word"))).alias("i", "s"))
    steps = steps.select("row", "i", "s.gap", "s.word").filter("word is not null")
    before = Window.partitionBy("row").orderBy("i")
    stop = F.sum(F.col("gap") + F.length("word")).over(before.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    steps = steps.withColumn("end", stop).withColumn("start", F.col("end") - F.length("word"))
    places = steps.select("row", F.lower("word").alias("t"), "start", "end").join(terms, "t").drop("t")
    spans = texts.select(F.col("row").alias("own"), F.explode("base").alias("s")).select("own", F.col("s.start").alias("from"), F.col("s.end").alias("upto"))
    touched = (F.col("from") < F.col("end")) & (F.col("start") < F.col("upto"))
    places = places.join(spans, (F.col("row") == F.col("own")) & touched, "left_anti")
    return places.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("added"))


NO_ADDED = "cast(array() as array<struct<start:int,end:int,action:string>>)"


def _with_added(df: DataFrame, text_col: str, keep: list[str], context_chars: int, min_contexts: int, generalise_at: float, remove_at: float) -> DataFrame:
    found = _analysed(df, text_col, keep, context_chars)
    added = _few(cut(_added(found, revealing(found, min_contexts, generalise_at, remove_at))))
    return found.join(added, "row", "left").withColumn("added", F.coalesce("added", F.expr(NO_ADDED)))


def personal_data(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    context_chars: int = CONTEXT_CHARS,
    min_contexts: int = MIN_CONTEXTS,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
) -> DataFrame:
    """(id, base, added) for each row: base spans, and terms to generalise or remove.

    Offsets are code points, end exclusive. Null and empty texts have no spans. Repeated rows and
    ids give as many rows, and each counts in N; ids may be null. A term whose disclosure equals a
    threshold is over it. An empty table gives no rows. Long texts are taken whole. Other columns
    of ``df`` may have any names.
    """
    found = _with_added(df, text_col, [id_col], context_chars, min_contexts, generalise_at, remove_at)
    return found.select("k0", "base", "added").toDF(id_col, "base", "added")


def redact(text: Column, base: Column, added: Column) -> Column:
    """``text`` with base spans as [KIND], generalised terms as [NUMBER] or [WORD], others gone."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    marks = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("put")))
    terms = F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["action"].alias("put")))

    def put(own: Column, m: Column, first: Column) -> Column:
        term = F.when(m["put"] == "remove", "").when(own.rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]")
        return F.when(~first, "").when(m["put"].isin("remove", "generalise"), term).otherwise(m["put"])

    done = F.array_join(_rewritten(_chunks(text), F.array_sort(F.concat(marks, terms)), put), "")
    return F.when((F.size(base) > 0) | (F.size(added) > 0), done).otherwise(text)


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with every span of its text redacted; all rows and columns are kept.

    ``length_col``, where there is one, becomes the new length of a text that has changed.
    A revealing term goes from every text that holds it, whether or not the entity is there too.
    Null, empty and repeated texts, ids, ties and empty tables are as in ``personal_data``; columns
    may have any names.
    """
    columns = df.columns
    keep = [c for c in columns if c != text_col]
    found = _with_added(df, text_col, keep, CONTEXT_CHARS, MIN_CONTEXTS, GENERALISE_AT, REMOVE_AT)
    changed = (F.size("base") > 0) | (F.size("added") > 0)
    found = found.withColumn("new", redact(F.col("t"), F.col("base"), F.col("added")))
    out = {c: F.col(f"k{i}") for i, c in enumerate(keep)} | {text_col: F.col("new")}
    if length_col in keep:
        kind = df.schema[length_col].dataType
        out[length_col] = F.when(changed, F.length("new").cast(kind)).otherwise(out[length_col])
    return found.select(*[out[c].alias(f"c{i}") for i, c in enumerate(columns)]).toDF(*columns)


def digest(base: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(base, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    terms = F.transform("added", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    base = digest(F.col("base"))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


ORACLE_SQL = rf"""
WITH kinds AS (SELECT * FROM (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (2, 'card', '[0-9]([\x20-]?[0-9])+'),
  (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) AS t(kind, name, pat)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, kind, name, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS value, unnest(g[1 : len(v)]) AS gap
  FROM (SELECT r, kind, name, regexp_extract_all(text, pat) AS v, regexp_split_to_array(text, pat) AS g FROM docs, kinds)),
placed AS (
  SELECT r, kind, name, value, regexp_replace(value, '[^0-9]', '', 'g') AS d,
    sum(length(gap) + length(value)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM m),
valid AS (
  SELECT r, kind, name, (stop - length(value))::INT AS s, stop::INT AS e, CASE WHEN kind >= 2 THEN d ELSE lower(value) END AS v
  FROM placed WHERE CASE kind WHEN 0 THEN true
    WHEN 1 THEN list_max(list_transform(string_split(value, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 256))) <= 255
    WHEN 2 THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
      CASE WHEN j % 2 = 1 THEN substr(d, length(d) + 1 - j, 1)::INT
           WHEN substr(d, length(d) + 1 - j, 1)::INT > 4 THEN 2 * substr(d, length(d) + 1 - j, 1)::INT - 9
           ELSE 2 * substr(d, length(d) + 1 - j, 1)::INT END)) % 10 = 0
    ELSE length(d) BETWEEN 9 AND 15 END),
base AS (
  SELECT r, kind, name, s, e, kind || ':' || v AS ent, 'class:' || kind || ':' || CASE kind WHEN 0 THEN regexp_replace(v, '^[^@]*', '')
    WHEN 1 THEN regexp_replace(v, '[0-9]+$', '') WHEN 2 THEN substr(v, 1, 6) ELSE substr(v, 1, length(v) - 4) END AS cls FROM valid),
keys AS (SELECT r, ent FROM base UNION SELECT r, cls FROM base),
sides AS (
  SELECT r, ent, cls, text, greatest(s - {CONTEXT_CHARS}, 0) AS f, e,
    substr(text, greatest(s - {CONTEXT_CHARS}, 0) + 1, s - greatest(s - {CONTEXT_CHARS}, 0)) AS a, substr(text, e + 1, {CONTEXT_CHARS}) AS b
  FROM base JOIN docs USING (r)),
parts AS (
  SELECT r, ent, cls, text, a || chr(10) || b AS context, f, e + length(b) AS stop, length(b) AS nb, f AS p0, a AS part FROM sides
  UNION ALL SELECT r, ent, cls, text, a || chr(10) || b, f, e + length(b), length(b), e, b FROM sides),
w AS (
  SELECT *, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS word, unnest(g[1 : len(v)]) AS gap
  FROM (SELECT *, row_number() OVER () AS part_id, regexp_extract_all(part, '{WORD}') AS v, regexp_split_to_array(part, '{WORD}') AS g FROM parts)),
wp AS (
  SELECT r, ent, cls, text, context, f, stop, nb, word,
    (p0 + sum(length(gap) + length(word)) OVER (PARTITION BY part_id ORDER BY i))::INT AS we FROM w),
near AS (
  SELECT r, ent, cls, md5(text) AS h, context, lower(word) AS t FROM wp
  WHERE (we - length(word) > f OR f = 0) AND (we < stop OR nb < {CONTEXT_CHARS})
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = wp.r AND b.s < wp.we AND wp.we - length(wp.word) < b.e)),
total AS (SELECT count(*) AS n FROM documents),
pairs AS (
  SELECT ent, t FROM near GROUP BY ent, t HAVING count(DISTINCT context) >= {MIN_CONTEXTS}
  UNION ALL SELECT cls, t FROM near GROUP BY cls, t HAVING count(DISTINCT h) >= {MIN_CONTEXTS}),
ents AS (SELECT ent, count(*) AS n_e FROM keys GROUP BY ent),
held AS (SELECT r, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS t FROM docs),
terms AS (SELECT t, count(*) AS n_t FROM held GROUP BY t),
shared AS (SELECT ent, t, count(*) AS n_te FROM pairs JOIN keys USING (ent) JOIN held USING (r, t) GROUP BY ent, t),
flagged AS (
  SELECT DISTINCT t FROM shared JOIN ents USING (ent) JOIN terms USING (t), total
  WHERE n_e < n AND 1 + log2(least(n_te / n_t, 1.0)) / log2(n / n_e) >= {GENERALISE_AT}),
hit AS (SELECT DISTINCT r FROM held JOIN flagged USING (t)),
hw AS (
  SELECT r, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS word, unnest(g[1 : len(v)]) AS gap
  FROM (SELECT r, regexp_extract_all(text, '{WORD}') AS v, regexp_split_to_array(text, '{WORD}') AS g FROM docs JOIN hit USING (r))),
spots AS (SELECT r, lower(word) AS t, (sum(length(gap) + length(word)) OVER (PARTITION BY r ORDER BY i))::INT AS we, length(word) AS n FROM hw),
added AS (
  SELECT r, string_agg('term:' || we - n || ':' || we, ',' ORDER BY we) AS a FROM spots JOIN flagged USING (t)
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = spots.r AND b.s < spots.we AND spots.we - spots.n < b.e) GROUP BY r),
b AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card,
    count(*) FILTER (kind = 3) AS n_phone, string_agg(name || ':' || s || ':' || e, ',' ORDER BY kind, s) AS spans FROM base GROUP BY r)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
  coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(spans, '')) AS base_sha256,
  concat_ws(',', nullif(coalesce(spans, ''), ''), a) AS spans
FROM docs LEFT JOIN b USING (r) LEFT JOIN added USING (r)
"""
