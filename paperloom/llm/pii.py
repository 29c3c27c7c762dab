"""Personal data, by patterns and by what the corpus discloses; DataFrame functions only.

Base spans are e-mail and IP addresses, card and phone numbers. The values found are protected entities. The words
of the texts that mention an entity disclose it when, over the whole corpus, they occur with it and hardly without it:
for a term t and an entity e with n(t), n(e) and n(t, e) texts of N, the term is flagged for the entity when

* n(t, e) >= ``SUPPORT`` (a term seen once tells nothing),
* n(t, e) / n(t) >= ``POSTERIOR`` (who knows the term can guess the entity), and
* log2(n(t, e) * N / (n(t) * n(e))) >= ``BITS`` (pointwise mutual information).

A term is a run of letters. Every occurrence of a flagged term outside base spans, in any text, is added as a span of the kind
``term``.
:func:`sanitised` generalises base spans to their kind and removes flagged terms. All counts are over all texts, whole; the
thresholds hold at every size. As n(t, e) <= n(e), entities of fewer than ``SUPPORT`` texts or of more than N / 2**``BITS`` can't have a
flagged term, and are left out before terms and entities are paired.

Null and empty texts have no spans. Rows with the same id are told apart by their text, and equal rows have equal spans. Spans are
ordered by start, then kind, so ties have one order. Long texts are read whole: places are summed in runs of ``RUN``, and texts
are cut in pieces of ``PIECE`` characters, so that the work grows with the text and not with its square. An empty table gives an
empty table. Other columns don't take part in :func:`private_spans`; :func:`sanitised` passes them on, whatever their names.
The patterns don't nest repeats, so that very long runs don't exhaust the regular expression engine's stack.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered, or_empty, stored, table

KINDS = ("email", "ip", "card", "phone", "term")
#: Numbers that are summed up one by one, and characters of a piece of text.
RUN, PIECE = 256, 1024
#: Flagged terms that are broadcast at most; more are joined by shuffling words.
BROADCAST_TERMS = 200_000
SUPPORT, POSTERIOR, BITS = 2, 0.5, 3.0

_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"[A-Za-z0-9-]"
#: A local part starts where its run of characters starts or where the last match ended; a domain goes on until two dots or
#: a last dot.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@(?={_DOMAIN}+\.{_DOMAIN})[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-]))"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Digits with any spaces and hyphens; cut at two of these in a row.
DIGITS, DOUBLE = r"[0-9][0-9\x20-]++", r"[\x20-]{2,}+"
TERM = r"\p{L}++"

_SPANS = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _running(sizes: Column, base: Column) -> Column:
    start = F.struct(base.cast("int").alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(sizes, start, lambda done, x: F.struct((done["at"] + x).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")), lambda done: done["out"])


def _before(sizes: Column) -> Column:
    """For each size, the sum of those before it; by runs, as an array that grows is copied for each entry."""
    last = F.floor((F.size(sizes) - 1) / RUN).cast("int")
    runs = F.when(F.size(sizes) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(sizes, k * RUN + 1, RUN))).otherwise(F.expr("cast(array() as array<array<int>>)"))
    bases = lambda r: _running(F.transform(r, lambda run: F.aggregate(run, F.lit(0), lambda x, y: x + y)), F.lit(0))
    return _let(runs, lambda r: F.flatten(F.zip_with(r, bases(r), _running)))


def _placed(values: Column, gaps: Column, at: Column) -> Column:
    """Spans of the values, where each stands after its gap."""

    def spans(x: Column) -> Column:
        gap = F.transform(F.slice(x["gaps"], 1, F.size(x["values"])), F.length)
        sizes = F.zip_with(x["values"], gap, lambda v, g: F.length(v) + g)
        starts = F.zip_with(_let(sizes, _before), gap, lambda before, g: at.cast("int") + before + g)
        return F.zip_with(x["values"], starts, lambda v, start: F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value")))

    return _let(F.struct(values.alias("values"), gaps.alias("gaps")), spans)


def spans_of(text: Column, pattern: str) -> Column:
    """(start, end, value) of each match."""
    return _placed(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(span: Column) -> Column:
    return F.forall(F.split(span["value"], r"\."), lambda x: F.coalesce(F.regexp_replace(x, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))


def _pieces(run: Column) -> Column:
    """A run of digits, cut at double separators; without a separator at its end."""
    values = F.split(run["value"], DOUBLE, -1)
    gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all(run["value"], F.lit(DOUBLE), F.lit(0)))

    def trimmed(x: Column) -> Column:
        value = F.regexp_replace(x["value"], "[ -]$", "")
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(value)).alias("end"), value.alias("value"))

    return F.transform(_placed(values, gaps, run["start"]), trimmed)


def _is_card(span: Column) -> Column:
    digits = _digits(span["value"])
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with the columns __text, __email, __ip, __card, __phone."""
    none = F.expr(f"cast(array() as {_SPANS})")
    rows = docs.withColumn("__text", or_empty(F.col(text_col)))
    text = F.col("__text")
    some = text.rlike("[0-9]{3}")
    rows = rows.withColumns({
        "__email": F.when(text.contains("@"), spans_of(text, EMAIL)).otherwise(none),
        "__ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans_of(text, IP), _is_ip)).otherwise(none),
        "__runs": F.when(some | text.rlike(r"[0-9][\x20-][0-9]"), F.filter(spans_of(text, DIGITS), lambda x: F.length(x["value"]) >= 12)).otherwise(none),
        "__phone": F.when(text.contains("+"), F.filter(spans_of(text, PHONE), lambda x: F.length(_digits(x["value"])).between(9, 15))).otherwise(none),
    })
    return rows.withColumn("__card", F.filter(F.flatten(F.transform("__runs", _pieces)), _is_card)).drop("__runs")


def _tagged(kinds: tuple[str, ...]) -> Column:
    """All spans of these kinds as (start, rank, end, kind, value), by start, then kind."""

    def named(rank: int, kind: str):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))

    each = [F.transform(f"__{kind}", named(rank, kind)) for rank, kind in enumerate(KINDS) if kind in kinds]
    return F.array_sort(F.concat(*each))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _marked(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with a mark for each span (start, end, ...); of spans that overlap, the first counts. Spans come by start."""

    def apart(x: Column) -> Column:
        """Those that start where all before have ended."""
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.expr("cast(array() as array<int>)").alias("out"))

        def step(done: Column, y: Column) -> Column:
            out = F.when(y["start"] < done["at"], F.concat(done["out"], F.array(done["k"]))).otherwise(done["out"])
            return F.struct(F.greatest(done["at"], F.when(y["start"] < done["at"], done["at"]).otherwise(y["end"])).alias("at"), (done["k"] + 1).alias("k"), out.alias("out"))

        within = F.aggregate(x, start, step, lambda done: done["out"])
        return _let(within, lambda w: F.when(F.size(w) == 0, x).otherwise(F.filter(x, lambda y, k: ~F.array_contains(w, k))))

    def part(pieces: Column, low: Column, high: Column) -> Column:
        first = F.floor(low / PIECE).cast("int")
        own = F.slice(pieces, first + 1, F.floor(high / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(own, ""), low - first * PIECE + 1, high - low)

    def written(x: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(x["spans"], lambda y: y["end"]))
        parts = F.zip_with(x["spans"], F.slice(ends, 1, F.size(x["spans"])), lambda y, low: F.concat(part(x["pieces"], low, y["start"]), mark(y)))
        return F.concat(F.array_join(parts, ""), part(x["pieces"], F.element_at(ends, -1), x["size"]))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = F.struct(_let(spans, apart).alias("spans"), pieces.alias("pieces"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, _let(whole, written)).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with a digit for each character of a span, so that no letter is left there and all else keeps its place."""
    return _marked(text, spans, lambda x: F.repeat(F.lit("0"), x["end"] - x["start"]))


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __hash, __base, __entities, __free) and the base spans by kind of each row; __free: the terms of a text that mentions
    an entity, outside its base spans. Texts stay behind."""
    rows = base_spans(docs, text_col)
    rows = rows.withColumns({"__base": _tagged(KINDS[:4]), "__hash": F.xxhash64("__text"), "__id": F.col(id_col)})
    rows = rows.withColumn("__entities", F.array_distinct(F.transform("__base", lambda x: F.xxhash64(F.lower(x["value"])))))
    free = F.when(F.size("__base") > 0, _terms(_blanked(F.col("__text"), F.col("__base"))))
    return rows.select("__id", "__hash", "__base", "__entities", free.alias("__free"), *(f"__{k}" for k in KINDS[:4]))


def _of_text(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """The join by id and text; of ``right``, a key has at most one row."""
    right = right.withColumnsRenamed({"__id": "__id2", "__hash": "__hash2"})
    return left.join(right, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2")), how).drop("__id2", "__hash2")


def flagged_terms(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(term): the distinct terms that disclose an entity. ``rows`` must be stored: they are read several times."""
    total = rows.count()
    mentions = rows.select("__id", "__hash", F.explode("__entities").alias("entity"))
    per_entity = stored(mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e").between(SUPPORT, total / 2**BITS)))
    own = mentions.join(per_entity.select("entity"), "entity").groupBy("__id", "__hash").agg(F.collect_set("entity").alias("entities"))  # one text's entities
    pairs = _of_text(rows.where(F.size("__entities") > 0).select("__id", "__hash", "__free"), own).select("entities", F.col("__free").alias("free"))
    joint = pairs.select(F.explode("entities").alias("entity"), "free").select("entity", F.explode("free").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= SUPPORT)
    per_term = texts.select(F.explode(_terms(F.col("__text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") >= SUPPORT)
    bits = F.log2(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    flagged = joint.join(per_term, "term").join(per_entity, "entity")
    return flagged.where((F.col("n_te") >= POSTERIOR * F.col("n_t")) & (bits >= BITS)).select("term").distinct()


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __hash) of each row with its base spans in __base and by kind, and the spans of flagged terms in __term."""
    rows = stored(with_base(docs, id_col, text_col))
    text = or_empty(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text"))
    flagged = stored(flagged_terms(rows, texts))
    some = flagged.limit(BROADCAST_TERMS + 1).count()
    if not some:
        return rows.withColumn("__term", F.expr(f"cast(array() as {_SPANS})")).drop("__entities", "__free")
    listed = texts.select("__id", "__hash", F.explode(_terms(F.col("__text"))).alias("term")).join(F.broadcast(flagged) if some <= BROADCAST_TERMS else flagged, "term")
    held = listed.groupBy("__id", "__hash").agg(F.collect_set("term").alias("__flagged"))  # one text's terms
    bases = rows.select("__id", "__hash", "__base").groupBy("__id", "__hash").agg(F.any_value("__base").alias("__base"))
    held = stored(_of_text(held, bases))
    # the one join that moves texts, in the same way at every size
    blank = _of_text(texts, held.hint("merge")).select("__id", "__hash", "__flagged", _blanked(F.col("__text"), F.col("__base")).alias("__blank"))
    found = F.filter(spans_of(F.col("__blank"), TERM), lambda x: F.array_contains("__flagged", F.lower(x["value"])))
    found = blank.select("__id", "__hash", found.alias("__found")).groupBy("__id", "__hash").agg(F.any_value("__found").alias("__found"))
    none = F.expr(f"cast(array() as {_SPANS})")
    return _of_text(rows, stored(found), "left").withColumn("__term", F.coalesce("__found", none)).drop("__found", "__entities", "__free")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_base) of each row; n_base: base spans of all kinds."""
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return marked(docs.select(id_col, text_col), id_col, text_col).select(
        F.col("__id").alias(id_col), *counts, F.sha2(_written(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _written(_tagged(KINDS)).alias("spans"), F.size("__term").cast("long").alias("n_term"), F.size("__base").cast("long").alias("n_base")
    )


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with base spans as [KIND] and terms removed; of spans that overlap, the first counts."""
    return _marked(text, spans, lambda x: F.when(x["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their texts sanitised. Texts without personal data and flagged terms stay as they are."""
    spans = marked(docs.select(id_col, text_col), id_col, text_col).select("__id", "__hash", _tagged(KINDS).alias("__spans")).where(F.size("__spans") > 0)
    spans = stored(spans.groupBy("__id", "__hash").agg(F.any_value("__spans").alias("__spans")))
    rows, (own_id, text) = numbered(docs, id_col, text_col)
    names = rows.columns
    rows = _of_text(rows.withColumns({"__id": F.col(own_id), "__hash": F.xxhash64(or_empty(F.col(text)))}), spans, "left")
    new = _rewritten(F.col(text), F.col("__spans"))
    return rows.withColumn(text, F.when(F.col("__spans").isNotNull(), new).otherwise(F.col(text))).select(*names).toDF(*docs.columns)


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), f AS (
  SELECT doc_id, 0 AS rank, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS v, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM d
  UNION ALL SELECT doc_id, 1, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), string_split_regex(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(t, '[0-9](?:[\x20-]?[0-9])+') FROM d
  UNION ALL SELECT doc_id, 3, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
  UNION ALL SELECT doc_id, 4, regexp_extract_all(t, '\p{L}+'), string_split_regex(t, '\p{L}+') FROM d
), u AS (
  SELECT doc_id, rank, unnest(range(len(v))) AS i, unnest(v) AS v, unnest(g[1:len(v)]) AS g FROM f WHERE len(v) > 0
), a AS (
  SELECT doc_id, rank, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS e FROM u
), c AS (
  SELECT doc_id, rank, v, e - length(v) AS s, e, regexp_replace(v, '[^0-9]', '', 'g') AS n FROM a
), b AS (
  SELECT doc_id, rank, v, s, e FROM c
  WHERE CASE rank WHEN 0 THEN true WHEN 1 THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x AS HUGEINT) <= 255, false)))
        WHEN 2 THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(n[-k] AS INTEGER) ELSE 2 * CAST(n[-k] AS INTEGER) - CASE WHEN n[-k] > '4' THEN 9 ELSE 0 END END)) % 10 = 0
        WHEN 3 THEN length(n) BETWEEN 9 AND 15 ELSE false END
), w AS (
  SELECT doc_id, lower(v) AS term, s, e FROM c WHERE rank = 4 AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND b.s < c.e AND b.e > c.s)
), m AS (
  SELECT DISTINCT doc_id, lower(v) AS entity FROM b
), n_e AS (
  SELECT entity, count(*) AS n_e FROM m GROUP BY 1
), n_t AS (
  SELECT lower(v) AS term, count(DISTINCT doc_id) AS n_t FROM c WHERE rank = 4 GROUP BY 1
), n_te AS (
  SELECT entity, term, count(*) AS n_te FROM m JOIN (SELECT DISTINCT doc_id, term FROM w) USING (doc_id) GROUP BY 1, 2
), flagged AS (
  SELECT DISTINCT term FROM n_te JOIN n_e USING (entity) JOIN n_t USING (term), (SELECT count(*) AS n FROM d) AS q
  WHERE n_e BETWEEN 2 AND q.n / 8.0 AND n_te >= 2 AND n_te >= 0.5 * n_t AND n_te * q.n >= 8 * n_t * n_e
), x AS (
  SELECT doc_id, rank, s, e FROM b UNION ALL SELECT doc_id, 4, s, e FROM w SEMI JOIN flagged USING (term)
), y AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone, count(*) FILTER (rank = 4) AS n_term,
         string_agg(['email', 'ip', 'card', 'phone', 'term'][rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(['email', 'ip', 'card', 'phone', 'term'][rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM x GROUP BY 1
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term, coalesce(n_email + n_ip + n_card + n_phone, 0) AS n_base
FROM d LEFT JOIN y USING (doc_id)
"""
