"""The queries opN_<name> over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, its decoding checked, and parity with the sentencepiece library. Null text encodes as empty (llm/sentencepiece.py)."""
    from lexiloom.llm.sentencepiece import encode

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), parity=True)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and random strings of every text; null text has none (llm/secrets.py)."""
    from lexiloom.llm.secrets import scan

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op2_sql() -> str:
    from lexiloom.llm import secrets as s

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    samples = ", ".join(f"({quoted(t)}, {quoted(k)})" for t, k in s.default_samples())
    searched = {kind: (s._LONG_ENOUGH[kind] or pattern, group, least) for kind, (pattern, group, least) in s.BASE.items()} | {"random": (s.RANDOM, 0, s.MIN_RANDOM)}
    kinds = " UNION ALL ".join(
        f"SELECT rid, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, {quoted(pattern)}, 0) AS m, regexp_extract_all(t, {quoted(pattern)}, {group}) AS g, string_split_regex(t, {quoted(pattern)}) AS p FROM d WHERE regexp_matches(t, {quoted(pattern)})"
        for rank, (kind, (pattern, group, least)) in enumerate(searched.items())
    )
    log = lambda n, of: f"ln((coalesce({n}, 0) + {s.SMOOTHING}) / (coalesce({of}, 0) + {s.SMOOTHING * s.SYMBOLS}))"
    return f"""
WITH samples(token, label) AS (VALUES {samples}),
chars AS (SELECT token, label, unnest(range(1, length(token) + 1)) AS i FROM samples),
pairs AS (SELECT label, CASE WHEN i > 1 THEN ascii(token[i - 1]) * 128 ELSE 0 END + ascii(token[i]) AS pair FROM chars),
counted AS (SELECT pair, count(*) FILTER (label = 'random') AS r, count(*) FILTER (label = 'ordinary') AS o FROM pairs GROUP BY pair),
before AS (SELECT pair // 128 AS prev, sum(r) AS ar, sum(o) AS ao FROM counted GROUP BY 1),
weights AS (SELECT p AS pair, CAST(round(1000 * ({log('r', 'ar')} - {log('o', 'ao')})) AS INTEGER) AS w FROM range(16384) AS x(p) LEFT JOIN counted ON pair = p LEFT JOIN before ON prev = p // 128),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
i AS (SELECT rid, rank, kind, least, unnest(m) AS token, unnest(g) AS grp, unnest(p[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM k),
located AS (SELECT rid, rank, kind, least, token, grp, sum(length(gap) + length(token)) OVER (PARTITION BY rid, rank ORDER BY i) AS e FROM i),
found AS (SELECT rid, rank, kind, CAST(e - length(token) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, token FROM located WHERE length(grp) >= least),
base AS (SELECT * FROM found WHERE rank < 3),
maybe AS (SELECT row_number() OVER () AS cid, f.* FROM found f WHERE rank = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = f.rid AND b.s < f.e AND f.s < b.e)),
steps AS (SELECT cid, token, unnest(range(1, length(token) + 1)) AS i FROM maybe),
scored AS (SELECT cid FROM steps JOIN weights ON pair = CASE WHEN i > 1 THEN ascii(token[i - 1]) * 128 ELSE 0 END + ascii(token[i]) GROUP BY cid HAVING sum(w) >= {s.MIN_SCORE}),
spans AS (SELECT rid, rank, kind, s, e FROM base UNION ALL SELECT rid, rank, kind, s, e FROM maybe SEMI JOIN scored USING (cid)),
told AS (SELECT rid, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, count(*) FILTER (rank = 3) AS n3,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS every FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, coalesce(n3, 0) AS n_random,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN told USING (rid)"""


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every text, windows over line breaks included; null text has none (llm/licenses.py)."""
    from lexiloom.llm.licenses import scan

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), windows=True)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or link-graph verdict of every page; a url without host is allowed unless a rule says else (llm/urls.py)."""
    from lexiloom.llm.urls import judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _op4_sql() -> str:
    from lexiloom.llm import urls as u

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    low = lambda x: f"translate({x}, '{u._UPPER}', '{u._LOWER}')"
    rules = sorted(u.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)})"
    rule, said = (" ".join(f"WHEN {fits(h, p)} THEN {quoted(x)}" for (h, p, v) in rules for x in [(h + p, v)[k]]) for k in (0, 1))
    rounds, last = [], "start"
    for k in range(u.ROUNDS):
        rounds.append(f"""r{k} AS MATERIALIZED (SELECT s.kind, s.host, {1 - u.DAMPING} * s.seed + {u.DAMPING} * coalesce(g.got, 0) AS score, s.seed FROM start s LEFT JOIN
  (SELECT p.kind, p.dst AS host, sum(p.part * n.score) AS got FROM parts p JOIN {last} n ON n.kind = p.kind AND n.host = p.src GROUP BY ALL) g USING (kind, host))""")
        last = f"r{k}"
    return f"""
WITH apart AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, html, {low("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM apart),
judged AS MATERIALIZED (SELECT page_id, host, path, html, CASE {rule} END AS rule, CASE {said} END AS said FROM named),
seeds AS (SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN said = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM judged WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, {low("dst")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, {quoted(u.LINK)}, 1)) AS dst FROM judged) WHERE host <> '' AND dst <> ''
  UNION ALL SELECT host, host FROM (SELECT host, unnest(regexp_extract_all(html, {quoted(u.RELATIVE)})) AS x FROM judged) WHERE host <> ''),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM links GROUP BY ALL),
ways AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
hosts AS (SELECT host FROM seeds UNION SELECT src FROM edges UNION SELECT dst FROM edges),
start AS MATERIALIZED (SELECT kind, host, coalesce(CASE kind WHEN 'trust' THEN trust ELSE distrust END, 0.0) AS seed, coalesce(CASE kind WHEN 'trust' THEN trust ELSE distrust END, 0.0) AS score FROM hosts CROSS JOIN (VALUES ('trust'), ('distrust')) AS k(kind) LEFT JOIN seeds USING (host)),
parts AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS part FROM ways UNION ALL SELECT kind, host, host, 1.0 FROM start s WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.kind = s.kind AND w.src = s.host)),
{', '.join(rounds)},
scores AS (SELECT host, round(sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END), 6) AS trust, round(sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END), 6) AS distrust FROM {last} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {u.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust FROM judged LEFT JOIN scores USING (host)"""


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross and relative entropy of every text against all good documents of its language; null where there are none (llm/lmscore.py)."""
    from lexiloom.llm.lmscore import good_ids, score

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), good_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")), whole=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after the edits of ``edit_script``, re-encoding only what they touch."""
    from pyspark.sql import functions as F

    from lexiloom.llm.tokencounts import apply_edits, build_trees, edit_script

    trees = build_trees(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # the count before rides along in the id: one pass, no join
    both = trees.withColumns({"doc_id": F.struct("doc_id", "n_tokens", F.size("counts").cast("long").alias("n_pretokens")), "edits": edit_script()})
    done = apply_edits(both)
    return done.select("doc_id.doc_id", "doc_id.n_tokens", "doc_id.n_pretokens", F.col("n_tokens").alias("n_tokens_edited"), "n_reencoded")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector; unusable vectors link with nothing (llm/neardup.py)."""
    from lexiloom.llm.neardup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, chance and draw of every document; null source, language and topic are values (llm/mixing.py)."""
    from lexiloom.llm.mixing import mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op7_sql() -> str:
    from lexiloom.llm import mixing as m

    key = lambda c: f"coalesce('=' || {c}, 'null')"
    topic = " ".join("WHEN " + " OR ".join(f"contains(t, '{x}')" for x in marks) + f" THEN '{name}'" for name, marks in m.TOPICS.items())
    steps, last = [], "r0"
    for r in range(m.ROUNDS):
        for k, c in enumerate(m.MARGINS):
            now = f"r{r}_{k}"
            steps.append(f"{now} AS MATERIALIZED (SELECT source, lang, topic, tokens, share * want / sum(share) OVER (PARTITION BY {c}) AS share FROM {last} JOIN want_{c} USING ({c}))")
            last = now
    wants = ", ".join(f"sum_{c} AS (SELECT {c}, pow(sum(tokens), {m.TARGETS[c]}) AS p FROM cells GROUP BY {c} HAVING sum(tokens) > 0), want_{c} AS MATERIALIZED (SELECT {c}, p / (SELECT sum(p) FROM sum_{c}) AS want FROM sum_{c})" for c in m.MARGINS)
    return f"""
WITH d AS (SELECT doc_id, {key('source')} AS source, {key('lang')} AS lang, coalesce(text, '') AS t FROM documents),
docs AS MATERIALIZED (SELECT doc_id, source, lang, '=' || CASE {topic} ELSE '{m.OTHER}' END AS topic, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  CAST(('0x' || substr(sha256('{m.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), sha256(t))), 1, 13)) AS BIGINT) / CAST({1 << 52} AS DOUBLE) AS draw FROM d),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL), {wants},
r0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / (SELECT sum(tokens) FROM cells) AS share FROM cells WHERE tokens > 0),
{', '.join(steps)},
weighed AS (SELECT source, lang, topic, round(share * (SELECT sum(tokens) FROM cells) / tokens, 6) AS weight FROM {last})
SELECT doc_id, substr(topic, 2) AS topic, n_tokens, coalesce(weight, 0.0) AS weight, coalesce(round(weight / (SELECT max(weight) FROM weighed), 6), 1.0) AS chance,
  draw < coalesce(round(weight / (SELECT max(weight) FROM weighed), 6), 1.0) AS sampled FROM docs LEFT JOIN weighed USING (source, lang, topic)"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every text; null text has no words and fails (llm/quality.py)."""
    from lexiloom.llm.quality import quality_rules

    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text; a text without words has fingerprint zero (llm/simhash.py)."""
    from lexiloom.llm.simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scans": _op2_sql(), "op4_url_filters": _op4_sql(), "op7_mix_to_target_weights": _op7_sql()}
