"""Paired statistics on the driver's tables: labels as four arms of outcomes per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as s
from ..sources.io import table
from ..streaming import events as ev
from .registry import query

ARMS = ("A1", "A2", "A3", "A4")
OUT = """
o AS (SELECT doc_id AS id, quality::DOUBLE AS A1, toxic::DOUBLE AS A2, (n_chars > 2000)::DOUBLE AS A3, (lang = 'en')::DOUBLE AS A4 FROM labels JOIN documents USING (doc_id)),
long AS (SELECT unnest(['A1', 'A2', 'A3', 'A4']) AS arm, id, unnest([A1, A2, A3, A4]) AS v FROM o)"""


def wide(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("A1"), F.col("toxic").cast("double").alias("A2"), (F.col("n_chars") > 2000).cast("double").alias("A3"), (F.col("lang") == "en").cast("double").alias("A4"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("v")) for a in ARMS])).alias("x")).select("x.arm", "id", "x.v")


@query(f"WITH {OUT} SELECT arm, id, v FROM long")
def outcomes_long(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d)


@query(f"WITH {OUT} SELECT id, A1, A2, A3, A4 FROM o WHERE A1 IS NOT NULL AND A2 IS NOT NULL AND A3 IS NOT NULL AND A4 IS NOT NULL")
def outcome_pivot(spark: SparkSession, d: str) -> DataFrame:
    return s.four_way(outcomes(spark, d), ARMS)


def boot_sql(value: str, times: int = s.RESAMPLES) -> str:
    return f"""
WITH {OUT}, v AS (SELECT id, {value} AS v, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM o),
draws AS (SELECT b, ('0x' || substr(md5('{s.SEED}-' || b || '-' || i), 1, 8))::BIGINT % n AS i FROM v, (SELECT unnest(range({times})) AS b)),
means AS (SELECT b, avg(v) AS m FROM draws JOIN v USING (i) GROUP BY b),
places AS (SELECT m, row_number() OVER (ORDER BY round(m, 9), b) - 1 AS r FROM means)
SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg(v) FROM v), 6) AS mean, round(max(m) FILTER (r = {int(0.025 * times)}), 6) AS lo, round(max(m) FILTER (r = {int(0.975 * times)}), 6) AS hi FROM places"""


def boot(df: DataFrame, times: int = s.RESAMPLES) -> DataFrame:
    return s.bootstrap(df, times).withColumns({c: F.round(c, 6) for c in ("mean", "lo", "hi")})


@query(boot_sql("A1"))
def bootstrap_mean_ci(spark: SparkSession, d: str, times: int = s.RESAMPLES) -> DataFrame:
    return boot(wide(spark, d).select("id", F.col("A1").alias("v")), times)


@query(boot_sql("A1 - A3"))
def bootstrap_delta_ci(spark: SparkSession, d: str, times: int = s.RESAMPLES) -> DataFrame:
    return boot(s.paired(outcomes(spark, d), "A1", "A3").select("id", (F.col("a") - F.col("b")).alias("v")), times)


@query(boot_sql("(A4 - A3) - (A2 - A1)"))
def bootstrap_did_ci(spark: SparkSession, d: str, times: int = s.RESAMPLES) -> DataFrame:
    return boot(s.four_way(outcomes(spark, d), ARMS).select("id", ((F.col("A4") - F.col("A3")) - (F.col("A2") - F.col("A1"))).alias("v")), times)


MCNEMAR = """
SELECT {key} a_wins, b_wins, CASE WHEN a_wins + b_wins = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))
  FROM (SELECT a_wins + b_wins AS m, unnest(range(least(a_wins, b_wins) + 1)) AS i))) END AS p,
  CASE WHEN b_wins > 0 THEN a_wins / b_wins WHEN a_wins > 0 THEN 'inf'::DOUBLE END AS odds_ratio"""


@query(f"WITH {OUT}, w AS (SELECT count(*) FILTER (A1 = 1 AND A4 = 0) AS a_wins, count(*) FILTER (A1 = 0 AND A4 = 1) AS b_wins FROM o) SELECT a_wins, b_wins, round(p, 6) AS p, round(odds_ratio, 6) AS odds_ratio FROM ({MCNEMAR.format(key='')} FROM w)")
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    return s.mcnemar(s.paired(outcomes(spark, d), "A1", "A4")).withColumns({c: F.round(c, 6) for c in ("p", "odds_ratio")})


@query(f"""
WITH {OUT}, v AS (SELECT A1 - A4 AS v FROM o WHERE A1 IS NOT NULL AND A4 IS NOT NULL), c AS (SELECT count(*) AS n, count(*) FILTER (v <> 0) AS m, count(*) FILTER (v > 0) AS up, avg(v) AS mean FROM v),
t AS (SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))) AS t FROM (SELECT m, unnest(range(least(up, m - up) + 1)) AS i FROM c))
SELECT n, m, round(mean, 6) AS mean, CASE WHEN m = 0 THEN 1 ELSE round(least(1, 2 * t), 6) END AS p FROM c, t""")
def permutation_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = s.paired(outcomes(spark, d), "A1", "A4").where("a is not null and b is not null").select("id", (F.col("a") - F.col("b")).alias("v"))
    return s.sign_flips(rows).withColumns({c: F.round(c, 6) for c in ("mean", "p")})


def flips_sql(times: int = s.RESAMPLES) -> str:
    return f"""
WITH {OUT}, v AS (SELECT A1 - A4 AS v, id FROM o), nz AS (SELECT v, id AS i FROM v WHERE v <> 0), m AS (SELECT count(*) AS m FROM nz),
f AS (SELECT b, sum(CASE WHEN ('0x' || substr(md5('{s.SEED}-' || b || '-' || i), 1, 8))::BIGINT & 1 = 1 THEN v ELSE -v END) AS s FROM nz, (SELECT unnest(range({times})) AS b) GROUP BY b)
SELECT (SELECT count(*) FROM v) AS n, m, round((SELECT avg(v) FROM v), 6) AS mean, CASE WHEN m = 0 THEN 1 ELSE round((SELECT count(*) FILTER (abs(s) >= abs((SELECT sum(v) FROM v)) - 1e-12) / count(*) FROM f), 6) END AS p FROM m"""


@query(flips_sql())
def permutation_mc(spark: SparkSession, d: str, times: int = s.RESAMPLES) -> DataFrame:
    rows = s.paired(outcomes(spark, d), "A1", "A4").select("id", (F.col("a") - F.col("b")).alias("v"))
    return s.permutation(rows, times).withColumns({c: F.round(c, 6) for c in ("mean", "p")})


@query("""
WITH t AS (SELECT n_name AS name, (n_nationkey * 7 % 25 + 1) / 400.0::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, name) - 1 AS r, count(*) OVER () AS m FROM t)
SELECT name, round(p, 6) AS p, round(max(least(1, (m - r) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_adj, max(least(1, (m - r) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) <= 0.05::DOUBLE AS reject FROM r""")
def holm(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "nation").select(F.col("n_name").alias("name"), ((F.col("n_nationkey") * 7 % 25 + 1) / 400.0).alias("p"))
    return s.holm(tests).withColumns({c: F.round(c, 6) for c in ("p", "p_adj")})


FAMILY = [("quality vs length", "A1", "A3"), ("toxic vs language", "A2", "A4"), ("length vs language", "A3", "A4"), ("absent", "A9", "A1")]
FAM = "fam(name, a, b) AS (VALUES ('quality vs length', 'A1', 'A3'), ('toxic vs language', 'A2', 'A4'), ('length vs language', 'A3', 'A4'), ('absent', 'A9', 'A1'))"


def family_sql(long: str, tested: str) -> str:
    """The report of a family on the outcomes ``long``; ``tested`` gives name, wins, p and odds of the pairs ``pr``."""
    return f"""
WITH {long}, {FAM}, pr AS (SELECT name, x.id AS id, x.v AS a, y.v AS b, x.v - y.v AS v FROM fam JOIN long x ON x.arm = fam.a JOIN long y ON y.arm = fam.b AND y.id = x.id WHERE x.v IS NOT NULL AND y.v IS NOT NULL),
pn AS (SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM pr),
means AS (SELECT name, b, avg(v.v) AS m FROM (SELECT name, b, ('0x' || substr(md5('{s.SEED}-' || b || '-' || i), 1, 8))::BIGINT % n AS i FROM pn, (SELECT unnest(range({s.RESAMPLES})) AS b)) JOIN (SELECT name, i, v FROM pn) v USING (name, i) GROUP BY name, b),
places AS (SELECT name, m, row_number() OVER (PARTITION BY name ORDER BY round(m, 9), b) - 1 AS r FROM means),
ends AS (SELECT name, max(m) FILTER (r = {int(0.025 * s.RESAMPLES)}) AS lo, max(m) FILTER (r = {int(0.975 * s.RESAMPLES)}) AS hi FROM places GROUP BY name),
size AS (SELECT name, count(*) AS n, avg(v) AS delta FROM pr GROUP BY name), {tested},
t AS (SELECT * FROM size JOIN ends USING (name) JOIN tests USING (name)), r AS (SELECT *, row_number() OVER (ORDER BY p, name) - 1 AS r, count(*) OVER () AS k FROM t)
SELECT name, n, round(delta, 6) AS delta, round(lo, 6) AS lo, round(hi, 6) AS hi, test, a_wins, b_wins, round(p, 6) AS p, round(odds_ratio, 6) AS odds_ratio,
  round(max(least(1, (k - r) * p)) OVER w, 6) AS p_adj, max(least(1, (k - r) * p)) OVER w <= 0.05::DOUBLE AS reject FROM r WINDOW w AS (ORDER BY p, name ROWS UNBOUNDED PRECEDING)"""


def reported(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("delta", "lo", "hi", "p", "odds_ratio", "p_adj")}).select("name", "n", "delta", "lo", "hi", "test", "a_wins", "b_wins", "p", "odds_ratio", "p_adj", "reject")


@query(family_sql(OUT.strip(), f"w AS (SELECT name, count(*) FILTER (a = 1 AND b = 0) AS a_wins, count(*) FILTER (a = 0 AND b = 1) AS b_wins FROM pr GROUP BY name), tests AS (SELECT 'mcnemar' AS test, * FROM ({MCNEMAR.format(key='name,')} FROM w))"))
def contrast_report(spark: SparkSession, d: str) -> DataFrame:
    return reported(s.contrasts(outcomes(spark, d), FAMILY))


RATES = """
o AS (SELECT doc_id AS id, round(n_chars / 3000.0::DOUBLE, 3) AS A1, quality::DOUBLE AS A2, round((n_chars % 97) / 97.0::DOUBLE, 3) AS A3, toxic::DOUBLE / 2 AS A4 FROM labels JOIN documents USING (doc_id)),
long AS (SELECT unnest(['A1', 'A2', 'A3', 'A4']) AS arm, id, unnest([A1, A2, A3, A4]) AS v FROM o)"""
FLIPPED = f"""
m AS (SELECT name, count(*) FILTER (v <> 0) AS m, sum(v) AS total FROM pr GROUP BY name),
nz AS (SELECT name, id, v, m, total, row_number() OVER (PARTITION BY name ORDER BY id) - 1 AS i FROM pr JOIN m USING (name) WHERE v <> 0),
f AS (SELECT name, b, any_value(total) AS total, sum(CASE WHEN (CASE WHEN m <= 13 THEN b >> i ELSE ('0x' || substr(md5('{s.SEED}-' || b || '-' || id), 1, 8))::BIGINT END) & 1 = 1 THEN v ELSE -v END) AS s
  FROM (SELECT *, unnest(range(CASE WHEN m <= 13 THEN 1 << m::INT ELSE {s.RESAMPLES} END)) AS b FROM nz) GROUP BY name, b),
tests AS (SELECT name, 'permutation' AS test, NULL::BIGINT AS a_wins, NULL::BIGINT AS b_wins, coalesce(p, 1) AS p, NULL::DOUBLE AS odds_ratio
  FROM m LEFT JOIN (SELECT name, count(*) FILTER (abs(s) >= abs(total) - 1e-12) / count(*) AS p FROM f GROUP BY name) USING (name))"""


@query(family_sql(RATES.strip(), FLIPPED.strip()))
def contrast_report_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates between 0 and 1 in four arms: paired sign flips, as for all outcomes that aren't hits or coverage."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    arms = {"A1": F.round(F.col("n_chars") / 3000.0, 3), "A2": F.col("quality").cast("double"), "A3": F.round((F.col("n_chars") % 97) / 97.0, 3), "A4": F.col("toxic") / 2.0}
    long = rows.select(F.col("doc_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), v.alias("v")) for a, v in arms.items()])).alias("x")).select("x.arm", "id", "x.v")
    return reported(s.contrasts(long, FAMILY, test="permutation"))


@query()
def glmm_2x2(spark: SparkSession, d: str) -> DataFrame:
    return s.mixed_effects(s.four_way(outcomes(spark, d), ARMS), ARMS).withColumn("estimate", F.round("estimate", 6))


# --- streams over events, each equal to its batch query


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ev.run_once(ev.tumbling(ev.event_stream(spark, f"{d}/events.parquet")))


@query("""
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 minute THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 minute AS "end", user_id, count(*) AS n FROM k GROUP BY user_id, s""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return ev.run_once(ev.sessions(ev.event_stream(spark, f"{d}/events.parquet")))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT DISTINCT event_id FROM events)")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = ev.run_once(ev.first_seen(ev.event_stream(spark, f"{d}/events.parquet"), ["event_id"]), "append")
    return kept.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
