"""Personal data: base patterns, and terms that reveal it by co-occurrence.

Base spans are the leftmost non-overlapping matches of four patterns. Each distinct value is a protected entity. What a term
near it reveals is the pointwise mutual information of the two in the corpus, PMI = log(N n_te / (n_t n_e)), as a share of
the entity's information content, log(N / n_e): 1 means that who reads the term knows the entity. N, n_t and n_e are
numbers of documents (all, with the term, with the entity), n_te of documents with the term in the entity's window.
Terms from ``REMOVE`` on are removed, from ``GENERALISE`` on generalised, wherever in the corpus they are written, the strictest action
over the entities that they reveal; a term needs two documents with different windows as evidence, since one occurrence, or
copies of it, tell nothing about the corpus. A window is the ``REACH`` characters of the whole text on either side of the entity.

Everything is DataFrame functions: the gaps between matches give positions, running sums per row place them.
Patterns are possessive and anchored at the start of a run, so long runs cost linear time and no stack.

Defined results: a null text is empty; a null id counts as one more id; rows of one id and text have the same spans; kinds
overlap freely in ``spans``, terms that overlap a base span are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

# kind -> (pattern, text that every match holds)
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[ -]?+[0-9])++", ""),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
KINDS = [*PATTERNS, "term", "general"]
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[\p{L}\p{N}]{3,}"
REACH, REMOVE, GENERALISE, EVIDENCE = 64, 0.9, 0.7, 2
LAST = 9223372036854775807


def _hits(body: Column, kind: str) -> Column:
    """Array of (kind, nth, value, gap): matches and the gap's length before each."""
    pattern, holds = PATTERNS[kind]
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(body, pattern, -1), F.char_length)
    n = F.size(found)
    zipped = F.arrays_zip(found.alias("value"), F.slice(gaps, 1, n).alias("gap"))
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), z["value"].alias("value"), z["gap"].alias("gap")))
    none = F.array().cast("array<struct<kind:string,nth:int,value:string,gap:int>>")
    may = F.contains(body, F.lit(holds)) if holds else F.lit(True)
    return F.when(may & (n > 0), rows).otherwise(none)


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def weighed(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), n), weighed), F.lit(0), lambda a, b: a + b), F.lit(10)) == 0


def _holds(kind: Column, value: Column) -> Column:
    """Whether a match passes its kind's rule."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    card = F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return (
        F.when(kind == "ip", value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")).when(kind == "card", card).when(kind == "phone", n.between(10, 15)).otherwise(F.lit(True))
    )


def _rows(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(body).alias("digest"), body.alias("body"), F.struct("*").alias("row"),
    )


def base_spans(found: DataFrame) -> DataFrame:
    """(doc, digest, copies, kind, start, end, value) of passing matches, one row per match."""
    once = found.groupBy("doc", "digest").agg(F.first("hits").alias("hits"), F.count(F.lit(1)).alias("copies"))
    hits = once.select("doc", "digest", "copies", F.inline("hits"))
    through = Window.partitionBy("doc", "digest", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    long = F.char_length("value").cast("long")
    placed = hits.withColumn("end", F.sum(F.col("gap") + long).over(through)).withColumn("start", F.col("end") - long)
    return placed.where(_holds(F.col("kind"), F.col("value"))).drop("nth", "gap")


def with_matches(rows: DataFrame) -> DataFrame:
    """The rows whose text has a match of any kind, so no other text is moved to where the spans are."""
    body = F.col("body")
    has = [F.contains(body, F.lit(holds)) & body.rlike(pattern) if holds else body.rlike(pattern) for pattern, holds in PATTERNS.values()]
    return rows.where(reduce(or_, has))


def in_whole_texts(base: DataFrame, rows: DataFrame) -> DataFrame:
    """``base`` with ``before`` and ``after``, the ``REACH`` characters of the whole text on either side of each span."""
    held = with_matches(rows).join(base.select("doc", "digest").distinct(), ["doc", "digest"], "left_semi")
    texts = held.groupBy("doc", "digest").agg(F.first("body").alias("body"))
    since = F.greatest(F.col("start") - REACH, F.lit(0))
    before = F.substring("body", (since + 1).cast("int"), (F.col("start") - since).cast("int"))
    after = F.substring("body", (F.col("end") + 1).cast("int"), F.lit(REACH))
    placed = base.join(texts, ["doc", "digest"])
    return placed.withColumns({"before": before, "after": after}).drop("body")


def _terms(window: Column, cut: str) -> Column:
    """Array of (term, at): whole words of a window and their places in it; a word at the cut end may be a part and is left out."""
    words = F.regexp_extract_all(window, F.lit(WORD), F.lit(0))
    gaps = F.transform(F.split(window, WORD, -1), F.char_length)

    def place(w, i):
        before = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b)
        return F.struct(w.alias("term"), (before + F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda a, b: a + F.char_length(b))).alias("at"))

    whole = F.transform(words, place)  # at most REACH / 4 words
    full = F.char_length(window) == REACH
    edge = (lambda t: t["at"] > 0) if cut == "left" else (lambda t: t["at"] + F.char_length(t["term"]) < REACH)
    return F.when(F.size(words) > 0, F.when(full, F.filter(whole, edge)).otherwise(whole)).otherwise(F.array().cast("array<struct<term:string,at:int>>"))


def near_terms(base: DataFrame) -> DataFrame:
    """(doc, digest, copies, entity, window, term, start, end): words within REACH characters of each base span."""
    entity = F.concat_ws(":", "kind", F.lower("value"))
    left = F.transform(_terms(F.col("before"), "left"), lambda t: F.struct(t["term"].alias("term"), (F.col("start") - F.char_length("before") + t["at"]).alias("from")))
    right = F.transform(_terms(F.col("after"), "right"), lambda t: F.struct(t["term"].alias("term"), (F.col("end") + t["at"]).alias("from")))
    rows = base.select("doc", "digest", "copies", entity.alias("entity"), F.md5(F.concat_ws("|", "before", "after").cast("binary")).alias("window"), F.explode(F.concat(left, right)).alias("t"))
    return rows.select(
        "doc", "digest", "copies", "entity", "window", F.lower("t.term").alias("term"), F.col("t.from").alias("start"), (F.col("t.from") + F.char_length("t.term")).alias("end")
    )


def disclosing(docs: DataFrame, base: DataFrame, terms: DataFrame) -> DataFrame:
    """(entity, term, kind): pairs whose term reveals the entity, with what is to be done."""
    near = terms.groupBy("entity", "term", "doc", "digest").agg(F.first("copies").alias("copies"), F.min("window").alias("window"))
    pairs = near.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count_distinct("window").alias("windows"))
    pairs = stored(pairs.where(F.col("windows") >= EVIDENCE), "pairs")
    entity = F.concat_ws(":", "kind", F.lower("value"))
    of_entity = base.select(entity.alias("entity"), "doc", "digest", "copies").distinct().groupBy("entity").agg(F.sum("copies").alias("n_e"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0)))
    of_term = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = docs.agg(F.count(F.lit(1))).first()[0]
    known = pairs.join(of_term.join(pairs.select("term").distinct(), "term", "left_semi"), "term").join(of_entity, "entity")
    pmi = F.log(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    share = F.try_divide(pmi, F.log(F.lit(float(total)) / F.col("n_e")))
    kind = F.when(share >= REMOVE, "term").when(share >= GENERALISE, "general")
    return known.select("entity", "term", kind.alias("kind")).where("kind is not null")


def occurrences(rows: DataFrame, revealed: DataFrame) -> DataFrame:
    """(doc, digest, kind, start, end): every place of a disclosing term in whole texts, with the strictest action over its entities."""
    flagged = revealed.groupBy("term").agg(F.max("kind").alias("kind"))  # "term" (removed) is after "general"
    found = F.regexp_extract_all(F.col("body"), F.lit(WORD), F.lit(0))
    words = rows.select("doc", "digest", F.explode(F.array_distinct(F.transform(found, F.lower))).alias("term"))
    held = words.join(flagged, "term", "left_semi").select("doc", "digest").distinct()
    texts = rows.join(held, ["doc", "digest"], "left_semi").groupBy("doc", "digest").agg(F.first("body").alias("body"))
    gaps = F.transform(F.split("body", WORD, -1), F.char_length)
    zipped = F.transform(F.arrays_zip(found.alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap")), lambda z, i: F.struct(i.alias("nth"), z["value"].alias("value"), z["gap"].alias("gap")))
    through = Window.partitionBy("doc", "digest").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    long = F.char_length("value").cast("long")
    placed = texts.select("doc", "digest", F.inline(zipped)).withColumn("end", F.sum(F.col("gap") + long).over(through)).withColumn("start", F.col("end") - long)
    return placed.withColumn("term", F.lower("value")).join(flagged, "term").select("doc", "digest", "kind", "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, digest, base, added) of every row: arrays of (start, kind number, end), ascending.

    ``added`` has every place of a disclosing term in whole texts, also in texts without its entity, but for places in base spans.
    """
    rows = _rows(docs)
    hits = F.concat(*[_hits(F.col("body"), k) for k in PATTERNS])
    found = stored(rows.select("doc_id", "doc", "digest", hits.alias("hits")), "hits")
    base = stored(base_spans(found.where(F.size("hits") > 0)), "base")
    terms = stored(near_terms(in_whole_texts(base, rows)), "terms")
    revealed = stored(disclosing(docs, base, terms), "disclosing")
    number = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    as_span = F.struct(F.col("start").cast("long").alias("start"), number.alias("kind"), F.col("end").cast("long").alias("end"))
    spans = base.groupBy("doc", "digest").agg(F.sort_array(F.collect_list(as_span)).alias("base"))
    more = occurrences(rows, revealed).groupBy("doc", "digest").agg(F.sort_array(F.collect_set(as_span)).alias("near"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    per = spans.join(more, ["doc", "digest"], "full").withColumn("base", F.coalesce("base", none))
    clear = F.filter("near", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    per = per.select("doc", "digest", "base", clear.alias("added"))
    out = found.select("doc_id", "doc", "digest").join(per, ["doc", "digest"], "left")
    return out.select("doc_id", "doc", "digest", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def sanitise(docs: DataFrame) -> DataFrame:
    """(row, sanitised): each input row as a struct, and its text with base spans named by kind, disclosing terms generalised or removed."""
    per = find(docs).select("doc", "digest", F.array_sort(F.concat("base", "added")).alias("spans")).distinct()
    per = stored(per.where(F.size("spans") > 0), "spans")  # few next to the texts
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    rows = _rows(docs).join(per, ["doc", "digest"], "left").withColumn("spans", F.coalesce("spans", none))
    first = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("kept")),
        lambda a, s: F.when(s["start"] >= a["upto"], F.struct(s["end"].alias("upto"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    rows = rows.withColumn("kept", first)
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS], F.lit(""), F.lit("[WORD]"))

    def piece(s, i):
        since = F.when(i > 0, F.get(F.col("kept"), i - 1)["end"]).otherwise(F.lit(0))
        old = F.substring("body", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        shape = F.when(old.rlike("^[0-9]+$"), "[NUMBER]").when(old.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        new = F.when(s["kind"] == len(KINDS) - 1, shape).otherwise(F.get(label, s["kind"]))
        return F.concat(F.substring("body", (since + 1).cast("int"), (s["start"] - since).cast("int")), new)

    end = F.coalesce(F.try_element_at("kept", F.lit(-1))["end"], F.lit(0))
    tail = F.substring("body", (end + 1).cast("int"), F.char_length("body"))
    return rows.select("row", F.concat(F.array_join(F.transform("kept", piece), ""), tail).alias("sanitised"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(i, kind):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{kind}")

    out = find(table(spark, folder, "documents"))
    every = F.array_sort(F.concat("base", "added"))
    return out.select("doc_id", *[count(i, k) for i, k in enumerate(PATTERNS)], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"))


def _sql() -> str:
    """The query in SQL: plain patterns, positions from the gaps between matches, the same statistics."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS no, '{k}' AS kind, regexp_extract_all(body, '{p}') AS f, string_split_regex(body, '{p}') AS g FROM d" for i, (k, p) in enumerate(plain.items())
    )
    place = "(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0))::BIGINT"
    digit = "substr(dg, j::INT, 1)::INT"
    luhn = f"list_sum(list_transform(range(1, length(dg)+1), lambda j: CASE WHEN (length(dg)-j)%2=0 THEN {digit} WHEN {digit}>4 THEN 2*{digit}-9 ELSE 2*{digit} END))%10=0"
    names = f"{KINDS}[no+1] || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (WHERE no={i}) AS n_{k}" for i, k in enumerate(plain))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
m AS ({found}),
h AS (SELECT *, unnest(range(1, len(f)+1)) AS i FROM m WHERE len(f)>0),
p AS (SELECT doc_id, no, kind, f[i] AS v, {place} AS s FROM h),
r AS (SELECT *, s+length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS dg, kind || ':' || lower(v) AS ent FROM p),
b AS (SELECT * FROM r WHERE CASE kind WHEN 'ip' THEN regexp_full_match(v, '{OCTET}(?:\\.{OCTET}){{3}}') WHEN 'card' THEN length(dg) BETWEEN 14 AND 19 AND {luhn}
  WHEN 'phone' THEN length(dg) BETWEEN 10 AND 15 ELSE TRUE END),
c AS (SELECT b.*, substr(body, greatest(s-{REACH}, 0)+1, least(s, {REACH})) AS bef, substr(body, e+1, {REACH}) AS aft FROM b JOIN d ON d.doc_id IS NOT DISTINCT FROM b.doc_id),
w AS (SELECT doc_id, ent, md5(bef || '|' || aft) AS win, bef AS ctx, s-length(bef) AS base, TRUE AS lft FROM c UNION ALL SELECT doc_id, ent, md5(bef || '|' || aft), aft, e, FALSE FROM c),
x AS (SELECT *, regexp_extract_all(ctx, '{WORD}') AS f, string_split_regex(ctx, '{WORD}') AS g FROM w),
y AS (SELECT *, unnest(range(1, len(f)+1)) AS i FROM x WHERE len(f)>0),
z AS (SELECT *, f[i] AS word, {place} AS plc FROM y),
t AS (SELECT doc_id, ent, win, lower(word) AS term, base+plc AS s, base+plc+length(word) AS e FROM z WHERE length(ctx)<{REACH} OR (lft AND plc>0) OR (NOT lft AND plc+length(word)<{REACH})),
nr AS (SELECT ent, term, doc_id, min(win) AS win FROM t GROUP BY ALL),
pr AS (SELECT ent, term, count(*) AS n_te FROM nr GROUP BY ALL HAVING count(DISTINCT win)>={EVIDENCE}),
oe AS (SELECT ent, count(DISTINCT doc_id) AS n_e FROM b GROUP BY ALL),
ot AS (SELECT term, count(*) AS n_t FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(body), '{WORD}')) AS term FROM d) WHERE term IN (SELECT term FROM pr) GROUP BY ALL),
al AS (SELECT count(*)::DOUBLE AS n FROM documents),
sh AS (SELECT ent, term, ln(n*n_te/(n_t*n_e))/nullif(ln(n/n_e), 0) AS share FROM pr JOIN ot USING (term) JOIN oe USING (ent), al),
dc AS (SELECT ent, term, CASE WHEN share>={REMOVE} THEN 4 ELSE 5 END AS no FROM sh WHERE share>={GENERALISE}),
fl AS (SELECT term, min(no) AS no FROM dc GROUP BY 1),
ws AS (SELECT doc_id, unnest(f) AS word, unnest(g[1:len(f)]) AS gap, unnest(range(1, len(f)+1)) AS i FROM (SELECT doc_id, regexp_extract_all(body, '{WORD}') AS f, string_split_regex(body, '{WORD}') AS g FROM d)),
wp AS (SELECT doc_id, lower(word) AS term, sum(length(gap)+length(word)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e, length(word) AS n FROM ws),
ad AS (SELECT doc_id, no, e-n AS s, e FROM wp JOIN fl USING (term) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id=wp.doc_id AND b.s<wp.e AND wp.e-wp.n<b.e)),
bs AS (SELECT doc_id, {counts}, string_agg({names}, ',' ORDER BY s, no, e) AS txt FROM b GROUP BY 1),
ev AS (SELECT doc_id, string_agg({names}, ',' ORDER BY s, no, e) AS txt FROM (SELECT doc_id, no, s, e FROM b UNION ALL SELECT doc_id, no, s, e FROM ad) GROUP BY 1)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in plain)}, sha256(coalesce(bs.txt, '')) AS base_sha256, coalesce(ev.txt, '') AS spans
FROM d LEFT JOIN bs ON bs.doc_id=d.doc_id LEFT JOIN ev ON ev.doc_id=d.doc_id
"""


SQL = _sql()
