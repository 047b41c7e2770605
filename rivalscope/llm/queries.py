"""The queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_k1", "_k2")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_k1", "_k2")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import encode_digests

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs, vocabulary("byte_bpe_50k.tiktoken"), pretoken_pattern()).drop("text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("byte_bpe_50k.json"), pretoken_pattern()).drop("text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import group_spellings

    return group_spellings(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_html_extraction": op4_html_extraction,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_counts": op8_token_counts,
        "op9_license_scan": op9_license_scan,
        "op10_sharding": op10_sharding,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_ranked_search": op12_ranked_search,
        "op13_source_mixing": op13_source_mixing,
    }


#: Windows of 13 words as strings joined by spaces (no word holds a space), looked up at every position.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[s : s + 12], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), hit AS (SELECT dw.doc_id, dw.s, dw.size, iw.item_id FROM dw JOIN iw USING (size, key)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
occ AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
often AS (SELECT term, count(*) AS n FROM occ GROUP BY 1),
bags AS (SELECT DISTINCT item_id, unnest(w) AS term FROM b),
ask AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS r, count(*) OVER (PARTITION BY item_id) AS c FROM bags JOIN often USING (term)) WHERE r <= 3 AND c >= 3),
p AS (SELECT doc_id, item_id, term, pos FROM occ JOIN ask USING (term)),
close AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near
  FROM (SELECT a.doc_id, a.item_id FROM p a JOIN p e ON a.doc_id = e.doc_id AND a.item_id = e.item_id AND e.pos BETWEEN a.pos AND a.pos + 12 GROUP BY a.doc_id, a.item_id, a.pos HAVING count(DISTINCT e.term) = 3) GROUP BY 1
),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN close USING (doc_id)
"""


#: Lines with a word; the shortest windows of 50 words from each line and to each line, as text; all but the first of equal ones go.
OP2_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
h AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '\S+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l) WHERE regexp_matches(line, '\S')
), c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY seq) AS through FROM h),
windows AS (
  SELECT s.doc_id, s.seq AS a, min(e.seq) AS b FROM c s JOIN c e ON e.doc_id = s.doc_id AND e.seq >= s.seq AND e.through - s.through + s.w >= 50 GROUP BY 1, 2
  UNION SELECT e.doc_id, max(s.seq), e.seq FROM c s JOIN c e ON e.doc_id = s.doc_id AND e.seq >= s.seq AND e.through - s.through + s.w >= 50 GROUP BY 1, 3
), named AS (
  SELECT windows.doc_id, a, b, string_agg(line, chr(10) ORDER BY seq) AS key FROM windows JOIN c ON c.doc_id = windows.doc_id AND seq BETWEEN a AND b GROUP BY ALL
), later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, a) AS n FROM named) WHERE n > 1),
gone AS (SELECT DISTINCT c.doc_id, c.pos FROM c JOIN later ON later.doc_id = c.doc_id AND c.seq BETWEEN a AND b),
kept AS (
  SELECT doc_id, list(line ORDER BY pos) AS lines FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.pos = x.pos) GROUP BY 1
)
SELECT l.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept.lines, chr(10)), '') END AS text, CAST(coalesce(len(l.lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_deleted
FROM l LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id)
"""
#: Every pair that shares a shingle, and all that is reachable over links.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM d
), s AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.v FROM reach JOIN links ON links.u = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON a = doc_id
"""


def op9_sql() -> str:
    """Each template's shingles are looked up at every position; windows as in the operator."""
    from .licenses import PERCENT, SHINGLE, TEMPLATES

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    each = f"[array_to_string(w[i : i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})]"
    listed = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in TEMPLATES.items())
    return f"""
WITH t AS (SELECT license, {words.format("text")} AS w FROM (VALUES {listed}) AS x(license, text)),
ts AS (SELECT license, len(w) AS size, CAST(ceil(len(w) / 4) AS BIGINT) AS stride, len(list_distinct({each})) AS n, unnest(list_distinct({each})) AS g FROM t),
d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, unnest({each}) AS g, unnest(range(len(w) - {SHINGLE - 1})) AS pos FROM d WHERE len(w) >= {SHINGLE}),
hit AS (SELECT doc_id, license, n, g, unnest(range(greatest(0, CAST(ceil((pos + {SHINGLE} - (size + stride - 1)) / stride) AS BIGINT)), pos // stride + 1)) AS k FROM s JOIN ts USING (g)),
part AS (SELECT doc_id, license, k, count(DISTINCT g) AS shared, 100.0 * count(DISTINCT g) / any_value(n) AS percent FROM hit GROUP BY 1, 2, 3 HAVING 100.0 * count(DISTINCT g) / any_value(n) >= {PERCENT}),
best AS (SELECT doc_id, license, max(percent) AS percent, max(shared) AS shared FROM part GROUP BY 1, 2),
found AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS licenses, max(percent) AS percent, arg_min(license, (-shared, license)) AS name FROM best GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(round(percent, 4), 0.0) AS best_percent, name AS best_license FROM d LEFT JOIN found USING (doc_id)
"""


#: Every document is scored for every item that shares a term with it.
OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), d AS (SELECT doc_id, row, CAST(len(w) AS BIGINT) AS n, w FROM t WHERE len(w) > 0),
facts AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d),
q AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (
  SELECT doc_id, row, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, row, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), weights AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS weight FROM p, facts GROUP BY term, docs),
scores AS (
  SELECT item_id, text, doc_id, row, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
  FROM p JOIN weights USING (term) JOIN q USING (term), facts GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""


#: The level of the water in closed form: sources in the order in which they fill; the first that holds at its own level.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][place % 3 + 1] AS weight, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS budget FROM s),
c AS (
  SELECT *, row_number() OVER fill AS turn, coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w WINDOW fill AS (ORDER BY cap / weight, place)
), l AS (SELECT arg_min((budget - taken) / rest, turn) FILTER ((budget - taken) / rest * weight <= cap) AS high FROM c),
t AS (SELECT source, source_size, CAST(least(cap, weight * high) AS DOUBLE) AS target FROM w, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
o AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY md5('20250114:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d
)
SELECT doc_id, size, source_size, target, CAST(copies * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - copies * source_size - before)) AS BIGINT) AS taken,
  o.source, copies, CAST(greatest(0, least(size, CAST(round(target) AS BIGINT) - copies * source_size - before)) AS BIGINT) AS part_words
FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_line_dedup": OP2_SQL, "op5_minhash_near_dedup": OP5_SQL, "op9_license_scan": op9_sql(), "op12_ranked_search": OP12_SQL, "op13_source_mixing": OP13_SQL}
