"""Queries over the driver's variants: similarity, archetypes, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import sequences
from trailmark.functions.cutting import new_path
from trailmark.operators import archetypes, risk, variants
from trailmark.plans import journeys

CRITICAL = ["purchase"]
QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def found(spark, sf_dir):
    return variants.variants(journeys.traces(spark, sf_dir))


#: DuckDB, brute force: variants ranked, the longest common subsequence of all pairs row by row, and
#: the sequential clustering, one variant after another.
RANKED = f"""{journeys.ONE.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1)},
rk AS (SELECT row_number() OVER (ORDER BY n_sessions DESC, string_split(path, ' > ')) AS rank, path, n_sessions, total_us, string_split(path, ' > ') AS p FROM variants),
en AS MATERIALIZED (SELECT *, CASE WHEN p[-1] = 'purchase' THEN p[-1] ELSE '(open)' END AS ends, len(p) AS n FROM rk),
pr AS (SELECT a.rank AS i, b.rank AS j, a.p AS pa, b.p AS pb FROM en a JOIN en b ON a.rank < b.rank AND a.ends = b.ends AND least(a.n, b.n) >= 0.65 * greatest(a.n, b.n)),
dp AS (SELECT i, j, pa, pb, 0 AS step, [0 FOR x IN range(0, len(pa) + 1)] AS above FROM pr
  UNION ALL SELECT i, j, pa, pb, step + 1, [CASE WHEN k = 0 THEN 0 ELSE list_max([greatest(above[m + 1], CASE WHEN pa[m] = pb[step + 1] THEN above[m] + 1 ELSE 0 END) FOR m IN range(1, k + 1)]) END FOR k IN range(0, len(pa) + 1)]
  FROM dp WHERE step < len(pb)),
sim AS MATERIALIZED (SELECT i, j, above[-1] / greatest(len(pa), len(pb)) AS sim FROM dp WHERE step = len(pb) AND above[-1] / greatest(len(pa), len(pb)) >= 0.65)"""
MEMBERS = f"""{RANKED},
near AS MATERIALIZED (SELECT en.rank, list(sim.i ORDER BY sim.sim DESC, sim.i) FILTER (sim.i IS NOT NULL) AS earlier FROM en LEFT JOIN sim ON sim.j = en.rank GROUP BY en.rank),
walk AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS seed, CAST([] AS BIGINT[]) AS seeds
  UNION ALL SELECT rank, coalesce(found, rank), CASE WHEN found IS NULL THEN list_append(seeds, rank) ELSE seeds END
  FROM (SELECT near.rank, walk.seeds, ([x FOR x IN near.earlier IF list_contains(walk.seeds, x)])[1] AS found FROM walk JOIN near ON near.rank = walk.rank + 1)),
mb AS (SELECT en.*, walk.seed FROM walk JOIN en USING (rank))"""
ARCHETYPES = f"""{MEMBERS},
gr AS (SELECT seed, CAST(sum(n_sessions) AS BIGINT) AS n_sessions, count(*) AS n_variants FROM mb GROUP BY seed),
cu AS (SELECT *, round(n_sessions * 100 / sum(n_sessions) OVER (), 2) AS share, row_number() OVER (ORDER BY n_sessions DESC, seed) AS nth FROM gr),
re AS (SELECT *, sum(share) OVER (ORDER BY nth ROWS UNBOUNDED PRECEDING) AS reached FROM cu)"""


def folded(source: str) -> str:
    """DuckDB: the common backbone of the paths p of each id in ``source`` (id, nth, p), one after
    another: the table of lengths row by row, then the way back through it, where a tie goes up."""
    return f"""fold AS (SELECT id, CAST(1 AS BIGINT) AS nth, p AS a, CAST([] AS VARCHAR[]) AS b, CAST([] AS BIGINT[][]) AS tab, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST([] AS VARCHAR[]) AS out, 'next' AS phase FROM {source} WHERE nth = 1
UNION ALL SELECT f.id, CASE WHEN phase = 'back' AND (i = 0 OR j = 0) THEN f.nth + 1 ELSE f.nth END, CASE WHEN phase = 'back' AND (i = 0 OR j = 0) THEN out ELSE a END, CASE phase WHEN 'next' THEN s.p ELSE b END,
  CASE phase WHEN 'next' THEN [[CAST(0 AS BIGINT) FOR x IN range(0, len(s.p) + 1)]] WHEN 'rows' THEN list_append(tab, [CASE WHEN k = 0 THEN 0 ELSE list_max([greatest(tab[-1][m + 1], CASE WHEN a[i + 1] = b[m] THEN tab[-1][m] + 1 ELSE 0 END) FOR m IN range(1, k + 1)]) END FOR k IN range(0, len(b) + 1)]) ELSE tab END,
  CASE phase WHEN 'next' THEN 0 WHEN 'rows' THEN i + 1 ELSE CASE WHEN i > 0 AND j > 0 AND (a[i] = b[j] OR tab[i][j + 1] >= tab[i + 1][j]) THEN i - 1 ELSE i END END,
  CASE phase WHEN 'next' THEN 0 WHEN 'rows' THEN len(b) ELSE CASE WHEN i > 0 AND j > 0 AND (a[i] = b[j] OR tab[i][j + 1] < tab[i + 1][j]) THEN j - 1 ELSE j END END,
  CASE WHEN phase = 'next' THEN [] WHEN phase = 'back' AND i > 0 AND j > 0 AND a[i] = b[j] THEN list_prepend(a[i], out) ELSE out END,
  CASE WHEN phase = 'next' THEN 'rows' WHEN phase = 'rows' AND i + 1 = len(a) THEN 'back' WHEN phase = 'back' AND (i = 0 OR j = 0) THEN 'next' ELSE phase END
  FROM fold f LEFT JOIN {source} s ON s.id = f.id AND s.nth = f.nth + 1 WHERE phase <> 'next' OR (s.p IS NOT NULL AND len(a) > 0)),
bb AS (SELECT id, arg_max(a, nth) AS backbone FROM fold WHERE phase = 'next' GROUP BY id)"""


@query(f"{RANKED} SELECT i, j, sim FROM sim")
def c_pair_similarity(spark, sf_dir):
    """Pairs of variants that reach the threshold."""
    rows = archetypes.ranked(found(spark, sf_dir), CRITICAL)
    return archetypes.pairs(rows).select("i", "j", "sim")


@query(f"""{RANKED}, src AS (SELECT rank AS id, unnest([1, 2]) AS nth, unnest([p, (SELECT p FROM en WHERE rank = 1)]) AS p FROM en), {folded("src")}
SELECT array_to_string(p, ' > ') AS path, array_to_string(backbone, ' > ') AS backbone, len(backbone) AS lcs FROM en JOIN bb ON bb.id = en.rank""")
def c_backbone(spark, sf_dir):
    """The longest common subsequence of each variant and the most frequent one."""
    rows = archetypes.ranked(found(spark, sf_dir), [])
    top = rows.where("rank = 1").select("app_id", F.col("path").alias("top"))
    common = sequences.backbone(F.col("path"), F.col("top"))
    joined = rows.join(top, "app_id").withColumns({"common": common, "lcs": sequences.lcs_length(F.col("path"), F.col("top"))})
    return joined.select(journeys.path_text(), F.array_join("common", " > ").alias("backbone"), F.col("lcs").cast("long").alias("lcs"))


@query(f"{MEMBERS} SELECT path, rank, seed, n_sessions FROM mb")
def c_archetype_members(spark, sf_dir):
    return archetypes.members(found(spark, sf_dir), CRITICAL).select(journeys.path_text(), "rank", "seed", "n_sessions")


@query(f"""{ARCHETYPES}, src AS (SELECT seed AS id, row_number() OVER (PARTITION BY seed ORDER BY rank) AS nth, p FROM mb), {folded("src")},
us AS (SELECT mb.seed, CAST(sum(n_users) AS BIGINT) AS n_users, sum(mb.total_us) / sum(mb.n_sessions) / 1e6 AS mean_duration_s FROM mb JOIN variants v ON v.path = mb.path GROUP BY mb.seed),
sc AS (SELECT seed, string_agg(DISTINCT x, ',' ORDER BY x) AS screens FROM (SELECT seed, unnest(p) AS x FROM mb) GROUP BY seed)
SELECT 'aj_' || lpad(CAST(nth AS VARCHAR), 3, '0') AS archetype_id, cu.n_sessions, us.n_users, n_variants, mean_duration_s, mb.path AS representative, array_to_string(backbone, ' > ') AS backbone, screens
FROM cu JOIN us USING (seed) JOIN sc USING (seed) JOIN mb ON mb.rank = cu.seed JOIN bb ON bb.id = cu.seed""")
def c_archetypes(spark, sf_dir):
    rows = archetypes.archetypes(archetypes.members(found(spark, sf_dir), CRITICAL))
    return rows.select("archetype_id", "n_sessions", "n_users", "n_variants", "mean_duration_s", F.array_join("representative", " > ").alias("representative"), F.array_join("backbone", " > ").alias("backbone"), F.array_join("screens", ",").alias("screens"))


#: After ten seeds, the nearest of these with an equal end, however unlike.
CAPPED = f"""{MEMBERS}, ten AS (SELECT seed, max(seed) OVER () AS full_at FROM (SELECT DISTINCT seed FROM mb ORDER BY seed LIMIT 10)),
cq AS (SELECT t.seed AS i, x.rank AS j, s.p AS pa, x.p AS pb FROM ten t JOIN en s ON s.rank = t.seed JOIN en x ON x.ends = s.ends AND x.rank > t.full_at),
dq AS (SELECT i, j, pa, pb, 0 AS step, [0 FOR x IN range(0, len(pa) + 1)] AS above FROM cq
  UNION ALL SELECT i, j, pa, pb, step + 1, [CASE WHEN k = 0 THEN 0 ELSE list_max([greatest(above[m + 1], CASE WHEN pa[m] = pb[step + 1] THEN above[m] + 1 ELSE 0 END) FOR m IN range(1, k + 1)]) END FOR k IN range(0, len(pa) + 1)] FROM dq WHERE step < len(pb)),
nq AS (SELECT j, arg_max(i, (sim, -i)) AS seed FROM (SELECT i, j, above[-1] / greatest(len(pa), len(pb)) AS sim FROM dq WHERE step = len(pb)) GROUP BY j)"""


@query(f"{CAPPED} SELECT path, rank, coalesce(nq.seed, CASE WHEN rank <= (SELECT max(full_at) FROM ten) THEN mb.seed ELSE rank END) AS seed, n_sessions FROM mb LEFT JOIN nq ON nq.j = mb.rank")
def c_archetypes_capped(spark, sf_dir):
    rows = archetypes.members(found(spark, sf_dir), CRITICAL, most=10)
    return rows.select(journeys.path_text(), "rank", "seed", "n_sessions")


@query(f"{ARCHETYPES} SELECT sum(n_variants) / count(*) AS compression, count(*) AS n_archetypes, min(nth) FILTER (reached >= 95) AS n_needed, sum(share) FILTER (nth <= 10) AS top_pct FROM re")
def c_compression(spark, sf_dir):
    return archetypes.compression(archetypes.archetypes(archetypes.members(found(spark, sf_dir), CRITICAL))).drop("app_id")


def scored(spark, sf_dir, member_rows):
    """Archetypes with score, rank, outcome and name."""
    rows = archetypes.archetypes(member_rows)
    signals = risk.by_screen(journeys.located(spark, sf_dir))
    money = variants.monetary(journeys.traces(spark, sf_dir)).join(member_rows.select("app_id", "path", "seed"), ["app_id", "path"]).groupBy("app_id", "seed").agg(F.sum("monetary").alias("monetary"))
    money = money.join(rows.select("app_id", "seed", "archetype_id"), ["app_id", "seed"]).drop("seed")
    seen = journeys.driver.events(spark, sf_dir).select("app_id", "screen_id").distinct()
    critical = F.col("screen_id").isin(CRITICAL)
    screens = seen.select("*", F.when(critical, 0.4).otherwise(0.0).alias("value"), critical.alias("critical"), F.initcap("screen_id").alias("display_name"), F.lit("shop").alias("domain"))
    return archetypes.named(archetypes.scores(rows, signals, money, screens.select("app_id", "screen_id", "value", "critical")), screens)


SCORES = f"""{ARCHETYPES},
rp AS (SELECT mb.seed, mb.p AS walk, mb.path FROM mb WHERE mb.rank = mb.seed), an AS (SELECT 'aj_' || lpad(CAST(nth AS VARCHAR), 3, '0') AS archetype_id, seed, n_sessions, n_variants, rp.walk, rp.path FROM cu JOIN rp USING (seed)),
ws AS (SELECT DISTINCT seed, unnest(p) AS screen_id FROM mb),
rk2 AS (FROM ({journeys.ORACLE_SQL["q_risk_by_screen"]})), mo AS (SELECT string_split(path, ' > ') AS p, monetary FROM ({journeys.ORACLE_SQL["m_monetary"]})),
fa AS (SELECT an.*, coalesce((SELECT sum(n_signals) FROM ws JOIN rk2 USING (screen_id) WHERE ws.seed = an.seed), 0) AS signals, EXISTS (FROM ws WHERE ws.seed = an.seed AND screen_id = 'purchase') AS critical,
  coalesce((SELECT CAST(sum(monetary) AS DOUBLE) FROM mb JOIN mo USING (p) WHERE mb.seed = an.seed), 0) AS monetary FROM an),
co AS (SELECT *, ln(1 + n_sessions) / max(ln(1 + n_sessions)) OVER () AS frequency, coalesce(signals / nullif(max(signals) OVER (), 0), 0) AS risk, greatest(coalesce(monetary / nullif(max(monetary) OVER (), 0), 0), CASE WHEN critical THEN 0.9 ELSE 0 END) AS business_value, 1.0::DOUBLE AS exposure FROM fa),
so AS (SELECT *, (frequency * 0.3 + business_value * 0.3 + risk * 0.25 + exposure * 0.15) * 100 AS score, CASE WHEN regexp_matches(walk[-1], 'failure|error|declined|rejected') THEN 'failed' WHEN regexp_matches(walk[-1], 'confirmation|success|complete|thank') THEN 'completed'
  WHEN regexp_matches(walk[-1], 'cart|payment_method|delivery_address|order_review|checkout') THEN 'abandoned' ELSE 'exploratory' END AS outcome FROM co),
sr AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, archetype_id) AS place, upper(walk[1][1]) || walk[1][2:] || ' to ' || upper(walk[-1][1]) || walk[-1][2:] || ' (' || outcome || ')' AS name FROM so)"""


@query(f"{SCORES} SELECT archetype_id, CAST(place AS INTEGER) AS rank, round(frequency, 6) AS frequency, round(business_value, 6) AS business_value, round(risk, 6) AS risk, exposure, round(score, 6) AS score, outcome, name FROM sr")
def c_scores(spark, sf_dir):
    """Archetypes with score, rank, outcome and name."""
    rows = scored(spark, sf_dir, archetypes.members(found(spark, sf_dir), CRITICAL))
    return rows.select("archetype_id", "rank", *[F.round(c, 6).alias(c) for c in (*archetypes.WEIGHTS, "score")], "outcome", "name")


@query(f"""{SCORES}, te AS (SELECT seed, p[-1] AS screen_id, sum(n_sessions) AS n FROM mb GROUP BY ALL), tl AS (SELECT seed, string_agg(screen_id || ':' || n, ',' ORDER BY n DESC, screen_id) AS ends FROM te GROUP BY seed)
SELECT archetype_id AS journey_id, CAST(place AS BIGINT) AS rank, name, round(score, 2) AS score, path AS sequence, CAST(n_sessions AS BIGINT) AS sessions, round(n_sessions * 100 / sum(n_sessions) OVER (), 2) AS session_share_pct, n_variants AS variants, CAST(signals AS BIGINT) AS risk_events, ends FROM sr JOIN tl USING (seed)""")
def k_catalogue(spark, sf_dir):
    """The journey catalogue, written and read back."""
    member_rows = archetypes.members(found(spark, sf_dir), CRITICAL)
    rows = scored(spark, sf_dir, member_rows).join(archetypes.terminal_screens(member_rows), ["app_id", "seed"])
    path = new_path(spark, "catalogue")
    listed = archetypes.catalogue(rows)
    archetypes.save_catalogue(listed, path)
    back = spark.read.schema(listed.drop("app_id").schema).json(path)
    ends = F.array_join(F.transform("terminal_screens", lambda x: F.concat(x["screen_id"], F.lit(":"), x["n_sessions"].cast("string"))), ",")
    return back.select("journey_id", F.col("rank").cast("long").alias("rank"), "name", "score", F.array_join("sequence", " > ").alias("sequence"), "sessions", "session_share_pct", "variants", "risk_events", ends.alias("ends"))
