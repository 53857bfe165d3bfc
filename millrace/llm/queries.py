"""The registered queries of this subpackage and their SQL.

Each applies its operator to its whole table. What null, empty, long, repeated and missing rows
and clashing columns give is stated by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html_text, jaccard_join, minhash, mixing, packing, quality, resampling, token_counts, token_files, topk, url_filter, vector_codes
from .common import read


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it: sources weigh 1, 2, 3, at most 3 times each."""
    return mixing.mix(read(spark, sf_dir, "documents"), weights=(1.0, 2.0, 3.0), max_copies=3).select("doc_id", "size", "source_size", "target", "taken")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of documents linked at 85% of four-word shingles."""
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), size=4, percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)


#: Fixed by the contract of op6.
HOST_RULES = [
    url_filter.HostRule("block", "com/en/"),
    url_filter.HostRule("allow", "example.com/en/7"),
    url_filter.HostRule("allow", "net/de/"),
    url_filter.HostRule("block", "example.net/de/8"),
    url_filter.HostRule("block", "org/es/"),
]
#: A filter list by topic: the names, and the forms (with their expressions in SQL) in which hosts and
#: paths of betting sites, adverts and trackers carry them.
_TOPICS = {
    "betting": (
        "bets casino casinos poker slots roulette jackpot bingo lottery sportsbook gambling blackjack baccarat craps keno betting wager freespins highroller scratchcards".split(),
        {"-{}.": r"-{}\.", "||{}.": r"^([^/]*\.)?{}\.", "||{}-": r"^([^/]*\.)?{}-", "-{}-": "-{}-", "/{}/": "/{}/", "/{}-": "/{}-", "-{}/": "-{}/"},
    ),
    "adverts and tracking": (
        "ads adserver adverts banners popunder tracker trackers tracking clicktrack retargeting affiliates sponsored interstitial beacon".split(),
        {"||{}.": r"^([^/]*\.)?{}\.", "/{}/": "/{}/", "/{}.": r"/{}\.", "-{}.": r"-{}\.", "@@/{}/policy": "/{}/policy", "@@||{}.*/about^": r"^([^/]*\.)?{}\..*/about([^0-9A-Za-z_.%-]|$)"},
    ),
}
_LINES = [(form.format(name), expression.format(name)) for names, forms in _TOPICS.values() for name in names for form, expression in forms.items()]
PATTERNS = url_filter.parse_rules(line for line, _ in _LINES)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host and path, the rule and pattern that fit, and the verdict."""
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), HOST_RULES, PATTERNS).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of each whose id is divisible by 50."""
    vectors = topk.integer_vectors(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by its text, its metadata and both."""
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens as read back from the files."""
    import public_tokenizers

    return token_files.token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and the quarter that is drawn."""
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), shortest=1, longest=2, buckets=10_000, seed=7, least_words=20, percent=25)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code of 8 parts with 16 entries each, learned in 6 rounds."""
    return vector_codes.compress(read(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near duplicates, 85% of five-word shingles, and whether it stays."""
    return minhash.near_components(read(spark, sf_dir, "documents"), size=5, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_html_text": op2_html_text,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_pack": op5_pack,
    "op6_url_filter": op6_url_filter,
    "op7_fingerprints": op7_fingerprints,
    "op8_topk": op8_topk,
    "op9_quality": op9_quality,
    "op10_token_files": op10_token_files,
    "op11_resample": op11_resample,
    "op12_vector_codes": op12_vector_codes,
    "op13_minhash": op13_minhash,
}

ORACLE: dict[str, str] = {}

ORACLE["op1_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), dc AS (
  SELECT *, CASE WHEN size > 0 THEN length(bin(size)) - 1 END AS class FROM d
), tot AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), named AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w FROM tot
), lev AS (
  SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM named
), tgt AS (
  SELECT source, source_size, round(least(3.0::DOUBLE * source_size, max(level) OVER () * w), 6) AS target FROM lev
), cls AS (
  SELECT source, class, sum(size)::BIGINT AS words FROM dc WHERE size > 0 GROUP BY source, class
), cc AS (
  SELECT cls.*, target, sqrt(pow(2.0::DOUBLE, class)) AS want,
    (target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY cls.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(sqrt(pow(2.0::DOUBLE, class)) * words) OVER (PARTITION BY cls.source ORDER BY class) AS c
  FROM cls JOIN tgt ON cls.source IS NOT DISTINCT FROM tgt.source
), ee AS (
  SELECT *, least(3.0::DOUBLE, max(c) OVER (PARTITION BY source) * want) AS e FROM cc
), pp AS (
  SELECT *, floor(e + 1e-9)::BIGINT AS whole, CASE WHEN e - floor(e + 1e-9) > 1e-9 THEN e - floor(e + 1e-9) ELSE 0.0::DOUBLE END AS p FROM ee
), rr AS (
  SELECT *, sum(p * words) OVER (PARTITION BY source) AS rest FROM pp
), u AS (
  SELECT dc.*, CASE WHEN size > 0 THEN whole ELSE 0 END AS whole, p, rest,
    (('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM dc LEFT JOIN rr ON dc.source IS NOT DISTINCT FROM rr.source AND dc.class = rr.class
), v AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS v FROM u
), s AS (
  SELECT *, CASE WHEN v IS NULL THEN 0 WHEN coalesce(sum(size) OVER (PARTITION BY source, v IS NULL ORDER BY v, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS extra FROM v
), g AS (
  SELECT source, max(rest) - sum(extra * size) AS gap FROM s GROUP BY source
), m AS (
  SELECT s.*, gap, row_number() OVER (PARTITION BY s.source ORDER BY CASE WHEN v IS NULL OR abs(gap - size * (1 - 2 * extra)) >= abs(gap) THEN 1 ELSE 0 END, abs(gap - size * (1 - 2 * extra)), v, doc_id, size) AS rn
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT m.doc_id, m.size, tgt.source_size, tgt.target,
  ((m.whole + CASE WHEN rn = 1 AND v IS NOT NULL AND abs(gap - m.size * (1 - 2 * extra)) < abs(gap) THEN 1 - extra ELSE extra END) * m.size)::BIGINT AS taken
FROM m JOIN tgt ON m.source IS NOT DISTINCT FROM tgt.source
"""

ORACLE["op6_url_filter"] = r"""
WITH h AS (
  SELECT page_id, url,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(regexp_replace(substr(url, strpos(url, '://') + 3), '^[^/?#]*', ''), '^[^?#]*') ELSE '' END AS path
  FROM pages
), r AS (
  SELECT * FROM (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')) AS t(verdict, rule)
), p AS (
  SELECT * FROM (VALUES @PATTERNS@) AS t(verdict, pattern, re)
), j AS (
  SELECT page_id, host, path,
    (SELECT max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) FROM r
      WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))) AS a,
    (SELECT max(struct_pack(exception := verdict = 'allow', n := length(pattern), pattern := pattern, verdict := verdict)) FROM p WHERE regexp_matches(host || path, re, 'i')) AS b
  FROM h
)
SELECT page_id, host, path, a.rule AS rule, coalesce(a.verdict, b.verdict, 'allow') AS verdict, b.pattern AS pattern FROM j
""".replace("@PATTERNS@", ", ".join(f"('{'allow' if line.startswith('@@') else 'block'}', '{line.removeprefix('@@')}', '{expression}')" for line, expression in _LINES))

ORACLE["op8_topk"] = r"""
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

ORACLE["op3_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), n AS (
  SELECT doc_id, len(s)::BIGINT AS n_shingles, hash(list_sort(s)) AS h FROM s
), cls AS (
  SELECT h, min(doc_id) AS rep FROM n WHERE n_shingles > 0 GROUP BY h
), x AS (
  SELECT s.doc_id, n.n_shingles AS n, unnest(s.s) AS g FROM s JOIN n USING (doc_id) JOIN cls ON cls.rep = s.doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r(id, root) AS (
  SELECT rep, rep FROM cls UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id
), c AS (
  SELECT id, min(root) AS root FROM r GROUP BY id
)
SELECT n.doc_id, n.n_shingles, CASE WHEN n.n_shingles > 0 THEN c.root ELSE n.doc_id END AS component_id
FROM n LEFT JOIN cls ON cls.h = n.h AND n.n_shingles > 0 LEFT JOIN c ON c.id = cls.rep
"""

ORACLE["op13_minhash"] = (
    ORACLE["op3_jaccard_join"].replace("len(w) < 4", "len(w) < 5").replace("len(w) - 2), lambda i: array_to_string(w[i:i + 3]", "len(w) - 3), lambda i: array_to_string(w[i:i + 4]")
    .replace("ELSE n.doc_id END AS component_id", "ELSE n.doc_id END AS component_id,\n  n.doc_id = CASE WHEN n.n_shingles > 0 THEN c.root ELSE n.doc_id END AS kept")
)

#: crc32 goes byte by byte through a table of 256 remainders, which is made by the rule of its polynomial.
ORACLE["op11_resample"] = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)
), w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), tw AS (
  SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), f AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w
), tf AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM tw
), grams AS (
  SELECT g FROM f UNION SELECT g FROM tf
), b AS (
  SELECT g, xor(list_reduce(list_transform(range(1, octet_length(encode(g)) + 1), lambda i: ('0x' || substr(hex(encode(g)), 2 * i - 1, 2))::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM grams, crc_table
), s AS (
  SELECT bucket, count(*) AS n FROM f JOIN b USING (g) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM tf JOIN b USING (g) GROUP BY bucket
), gain AS (
  SELECT r.i AS bucket, floor(1000 * ln(((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)) / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
  FROM range(10000) AS r(i) LEFT JOIN s ON s.bucket = r.i LEFT JOIN t ON t.bucket = r.i
), d AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (g) JOIN gain USING (bucket) GROUP BY doc_id
), h AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(d.n, 0)::BIGINT AS n_features, coalesce(d.weight, 0) AS weight,
    coalesce(d.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN d USING (doc_id)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS eligible FROM h
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * eligible // 100 THEN r END::BIGINT AS rank FROM o
"""


def _rounds_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Rounds of assignment and means as one common table each."""
    near = """a{i} AS MATERIALIZED (
  SELECT vec_id, label, part, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := entry)) AS best
  FROM x JOIN c{i} USING (part) GROUP BY ALL
)"""
    mean = """c{j} AS MATERIALIZED (
  SELECT c{i}.part, c{i}.entry, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY pos) AS c FROM (
      SELECT part, best.e AS entry, pos, sum(v[pos])::DOUBLE AS s, count(*) AS n FROM a{i}, range(1, 1 + (SELECT max(len(v)) FROM x)) AS r(pos) GROUP BY ALL
    ) GROUP BY ALL
  ) AS m ON m.part = c{i}.part AND m.entry = c{i}.entry
)"""
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [mean.format(i=i, j=i + 1), near.format(i=i + 1)]
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, p.part, v[p.part * len(v) // {parts} + 1:(p.part + 1) * len(v) // {parts}] AS v FROM k, range({parts}) AS p(part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})
), {", ".join(steps)}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL
), book AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, book
"""


ORACLE["op12_vector_codes"] = _rounds_sql()
