"""The catalogue: one query for each operator over the driver's tables, with independent SQL that checks it.

Each entry of ``_ALL`` is (name, callable, SQL or None). Thresholds that would select
nothing on these tables are set to values that select something; the operators'
defaults are their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as X
from .operators import collectors as C
from .operators import graph as G
from .operators import report as R
from .operators import scan as N
from .operators import signals as S
from .operators import similarity as M
from .operators import state as D
from .plans import roles as P
from .sources import code as Y
from .sources import sinks as K

WORDS = {"license": 0.45, "released": 0.55, "token": 0.8, "copyright": 0.35}
NOW, ORDERS = P.EVENTS_NOW, P.ORDERS_NOW
_ALL: list = []


def query(sql: str | None = None):
    def add(f):
        _ALL.append((f.__name__, f, sql))
        return f

    return add


def r6(c):
    return F.round(c, 6)


# ---- SQL shared by several checks

LINES = """lines AS (
  SELECT path, CAST(i AS INTEGER) AS line, text FROM (
    SELECT source || '/' || doc_id || '.md' AS path, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS text,
           generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS i FROM documents))"""
ID = "substr(sha256(coalesce(source, '') || chr(0) || coalesce(kind, '') || chr(0) || coalesce(file_path, '') || chr(0) || coalesce(line, 0) || chr(0) || coalesce(title, '')), 1, 8)"
PRIO = "CASE WHEN confidence >= 0.8 THEN 1 WHEN confidence >= 0.6 THEN 2 WHEN confidence >= 0.4 THEN 3 ELSE 4 END"
MARK = rf"""{LINES}, hit AS (
  SELECT path, line, regexp_extract(text, '(?i)\b(LICENSE|RELEASED|TOKEN|COPYRIGHT)\b(?:\([^)]*\))?\s*[:>\-]?\s*(.*)', 1) AS w,
         trim(regexp_extract(text, '(?i)\b(LICENSE|RELEASED|TOKEN|COPYRIGHT)\b(?:\([^)]*\))?\s*[:>\-]?\s*(.*)', 2)) AS msg, text
  FROM lines WHERE regexp_matches(text, '(?i)\b(LICENSE|RELEASED|TOKEN|COPYRIGHT)\b')),
markers AS (
  SELECT 'todos' AS source, lower(w) AS kind, path AS file_path, line,
         CASE WHEN msg = '' THEN '`' || upper(w) || '` comment (no description)' ELSE upper(w) || ': ' || msg END AS title,
         CASE lower(w) WHEN 'license' THEN 0.45 WHEN 'released' THEN 0.55 WHEN 'token' THEN 0.8 ELSE 0.35 END::DOUBLE AS confidence FROM hit)"""
CHURN = """churn AS (
  SELECT event_type || '/' || (event_id % 50) AS path, count(*) AS changes, count(DISTINCT user_id) AS authors FROM events
  WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 90 DAY GROUP BY 1)"""


def marker_signals(spark: SparkSession, d: str) -> DataFrame:
    return C.markers(P.lines(P.files(spark, d)), {k.upper(): v for k, v in WORDS.items()}, prefix=r"\b")


def stable_signals(spark: SparkSession, d: str) -> DataFrame:
    """Marker signals whose texts have no quotation, so that both engines see one list."""
    return S.with_id(marker_signals(spark, d))


@query(f"WITH {MARK} SELECT source, kind, file_path, line, title, confidence, {ID} AS signal_id, CAST({PRIO} AS INTEGER) AS priority FROM markers")
def marker_scan(spark, d):
    return S.with_id(marker_signals(spark, d)).withColumn("priority", X.priority(F.col("confidence")))


@query(f"WITH {LINES} SELECT path, count(*) AS n, CAST(max(line) AS INTEGER) AS last_line FROM lines GROUP BY path")
def line_reader(spark, d):
    return P.lines(P.files(spark, d)).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last_line"))


@query("""WITH x AS (SELECT path, CASE doc_id % 6 WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE 't' END AS title, CASE doc_id % 6 WHEN 3 THEN '/' || path WHEN 4 THEN CASE WHEN doc_id % 12 = 4 THEN '../' ELSE 'a/b/../.././../' END || path WHEN 2 THEN 'a/./../' || path ELSE path END AS file_path,
   CASE doc_id % 6 WHEN 5 THEN 1.5 ELSE 0.5 END AS confidence FROM (SELECT doc_id, source || '/' || doc_id || '.md' AS path FROM documents))
 SELECT file_path, concat_ws(',', CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN file_path LIKE '/%' THEN 'absolute' END, CASE WHEN file_path LIKE '..%' OR file_path LIKE 'a/b/../..%' THEN 'traversal' END, CASE WHEN confidence > 1 THEN 'confidence' END) AS reasons FROM x""")
def validate_rejects(spark, d):
    x = P.table(spark, d, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    k = F.col("doc_id") % 6
    x = x.select(F.lit("s").alias("source"), F.when(k == 1, "").when(k == 2, " ").otherwise("t").alias("title"), F.when(k == 3, F.concat(F.lit("/"), "path")).when(k == 4, F.concat(F.when(F.col("doc_id") % 12 == 4, "../").otherwise("a/b/../.././../"), "path")).when(k == 2, F.concat(F.lit("a/./../"), "path")).otherwise(F.col("path")).alias("file_path"), F.when(k == 5, 1.5).otherwise(0.5).alias("confidence"))
    return S.rejects(x).select("file_path", "reasons")


@query(f"""WITH {LINES}, s AS (SELECT 'l' AS source, 'line' AS kind, split_part(path, '/', 1) AS file_path, 0 AS line, text AS title, (line % 10) / 10.0::DOUBLE AS confidence, path, line AS pos FROM lines),
 h AS (SELECT *, {ID} AS signal_id, row_number() OVER (PARTITION BY {ID} ORDER BY path, pos) AS rn, max(confidence) OVER (PARTITION BY {ID}) AS top FROM s)
 SELECT signal_id, path, pos, round(top, 6) AS confidence FROM h WHERE rn = 1""")
def dedup_signals(spark, d):
    x = P.lines(P.files(spark, d))
    s = x.select(F.lit("l").alias("source"), F.lit("line").alias("kind"), F.split("path", "/")[0].alias("file_path"), F.lit(0).alias("line"), F.col("text").alias("title"), ((F.col("line") % 10) / 10.0).alias("confidence"), "path", F.col("line").alias("pos"))
    return S.deduplicated(S.with_id(s), ["path", "pos"]).select("signal_id", "path", "pos", r6("confidence").alias("confidence"))


@query(f"WITH {MARK} SELECT file_path, line, title, confidence FROM markers ORDER BY {PRIO}, confidence DESC, file_path, line, title LIMIT 25")
def cap_topk(spark, d):
    return S.capped(marker_signals(spark, d), 25, ["file_path", "line", "title"]).select("file_path", "line", "title", "confidence")


BOOSTABLE = "CASE event_type WHEN 'error' THEN 'churn' WHEN 'signup' THEN 'low-lottery-risk' WHEN 'purchase' THEN 'vulnerable-dependency' ELSE event_type END"


@query(f"""WITH s AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS f, {BOOSTABLE} AS kind, (event_id % 10) / 10.0::DOUBLE AS c FROM events),
 k AS (SELECT f, bool_or(kind = 'churn') a, bool_or(kind = 'vulnerable-dependency') b, bool_or(kind = 'low-lottery-risk') l FROM s WHERE f <> '' GROUP BY f)
 SELECT event_id, kind, round(least(1.0, c + CASE WHEN coalesce(a, false) AND kind <> 'churn' THEN 0.05 ELSE 0 END + CASE WHEN coalesce(b, false) AND kind <> 'vulnerable-dependency' THEN 0.10 ELSE 0 END + CASE WHEN coalesce(l, false) AND kind <> 'low-lottery-risk' THEN 0.05 ELSE 0 END), 6) AS confidence
 FROM s LEFT JOIN k USING (f)""")
def colocation_boost(spark, d):
    e = P.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "churn").when(F.col("event_type") == "signup", "low-lottery-risk").when(F.col("event_type") == "purchase", "vulnerable-dependency").otherwise(F.col("event_type"))
    s = e.select("event_id", F.when(F.col("user_id") % 7 == 0, "").otherwise(F.col("user_id").cast("string")).alias("file_path"), kind.alias("kind"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))
    return S.boosted(s).select("event_id", "kind", r6("confidence").alias("confidence"))


@query(f"WITH {MARK} SELECT kind, count(*) AS n FROM markers WHERE confidence >= 0.45 GROUP BY kind")
def min_confidence(spark, d):
    return S.kind_counts(S.at_least(marker_signals(spark, d), 0.45))


@query(f"WITH {MARK} SELECT file_path, line, kind FROM markers WHERE kind IN ('license', 'token')")
def kind_filter(spark, d):
    return S.of_kinds(marker_signals(spark, d), " License, TOKEN ").select("file_path", "line", "kind")


@query(f"WITH {MARK} SELECT 'docs/' || file_path AS file_path, line, 'w1' AS workspace FROM markers")
def workspace_stamp(spark, d):
    return S.in_workspace(marker_signals(spark, d), "w1", "docs/").select("file_path", "line", "workspace")


@query(f"WITH {MARK} SELECT file_path, line, CASE WHEN regexp_matches(file_path, '^(.*/)?src1/.*$') THEN 1 WHEN regexp_matches(file_path, '^(.*/)?[^/]*5\\.md$') THEN 2 WHEN regexp_matches(file_path, '^src[^/]/[^/]*$') THEN 3 END AS priority FROM markers")
def priority_overrides(spark, d):
    s = marker_signals(spark, d).withColumn("priority", F.lit(None).cast("int"))
    return S.overridden(s, [("src1/**", 1), ("*5.md", 2), ("src?/*", 3)]).select("file_path", "line", "priority")


@query("""SELECT event_type || '/' || (event_id % 50) AS path, count(*) AS changes, count(DISTINCT user_id) AS authors, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS author_list,
 round(CASE WHEN count(*) >= 30 THEN 0.8 WHEN count(*) <= 10 THEN 0.4 ELSE 0.4 + (count(*) - 10) / 20.0 * 0.4 END::DOUBLE, 6) AS confidence FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 90 DAY GROUP BY 1 HAVING count(*) >= 10""")
def churn_files(spark, d):
    return C.churn(P.commits(spark, d), NOW).withColumn("confidence", r6("confidence"))


@query(r"""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Revert "' || substr(text, 1, 20) || '"' WHEN 1 THEN 'revert: ' || role ELSE substr(text, 1, 10) END AS subject, CASE turn % 4 WHEN 2 THEN 'This reverts commit abcdef123.' ELSE '' END AS body, 'c' || conv_id || '00000' AS sha FROM conversations)
 SELECT conv_id, turn, CASE WHEN regexp_extract(subject, '(?i)^Revert\s+"(.+)"', 1) <> '' THEN regexp_extract(subject, '(?i)^Revert\s+"(.+)"', 1) WHEN regexp_extract(subject, '(?i)^revert:\s*(.+)', 1) <> '' THEN regexp_extract(subject, '(?i)^revert:\s*(.+)', 1) ELSE 'commit ' || substr(sha, 1, 7) END AS reverted
 FROM c WHERE turn % 4 IN (0, 1, 2) AND (turn % 4 <> 0 OR regexp_matches(subject, '(?i)^Revert\s+"(.+)"'))""")
def revert_detect(spark, d):
    t = F.col("turn") % 4
    subject = F.when(t == 0, F.concat(F.lit('Revert "'), F.substring("text", 1, 20), F.lit('"'))).when(t == 1, F.concat(F.lit("revert: "), "role")).otherwise(F.substring("text", 1, 10))
    c = P.table(spark, d, "conversations").select("conv_id", "turn", subject.alias("subject"), F.when(t == 2, "This reverts commit abcdef123.").otherwise("").alias("body"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("00000")).alias("sha"))
    return C.reverts(c).select("conv_id", "turn", "reverted")


@query("""WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS name, CAST(round((epoch(TIMESTAMP '2001-08-02') - epoch(max(o_orderdate))) / 86400.0) AS BIGINT) AS days FROM orders GROUP BY o_custkey)
 SELECT name, days, round(CASE WHEN days >= 90 THEN 0.6 WHEN days <= 30 THEN 0.3 ELSE 0.3 + (days - 30) / 60.0 * 0.3 END::DOUBLE, 6) AS confidence FROM b WHERE days >= 30""")
def stale_branches(spark, d):
    return C.stale_branches(P.branches(spark, d), ORDERS).withColumn("confidence", r6("confidence"))


@query(f"WITH {LINES} SELECT path, count(*) AS n_lines, round(least(0.4 + 0.4 * (count(*) / 20.0 - 1), 0.8)::DOUBLE, 6) AS confidence FROM lines GROUP BY path HAVING count(*) > 20")
def large_files(spark, d):
    return C.large_files(P.lines(P.files(spark, d)), 20).withColumn("confidence", r6("confidence"))


@query("""WITH g AS (SELECT source AS dir, count(*) FILTER (WHERE l.doc_id IS NULL) AS source_files, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS test_files FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source)
 SELECT dir, source_files, test_files, round(test_files / source_files::DOUBLE, 6) AS ratio, CASE WHEN test_files = 0 THEN 'NO TESTS' WHEN test_files / source_files < 0.1 THEN 'CRITICAL' WHEN test_files / source_files < 0.3 THEN 'LOW' WHEN test_files / source_files < 0.5 THEN 'MODERATE' ELSE 'GOOD' END AS assessment,
 source_files >= 3 AND test_files / source_files < 0.6 AS low FROM g WHERE source_files > 0""")
def test_ratio(spark, d):
    t = P.table(spark, d, "labels").select("doc_id").distinct().withColumn("t", F.lit(True))
    x = P.table(spark, d, "documents").join(t, "doc_id", "left").select(F.col("source").alias("dir"), F.coalesce("t", F.lit(False)).alias("is_test"))
    return C.test_ratio(x, 3, 0.6).withColumn("ratio", r6("ratio"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id + 1 OR l.doc_id = d.doc_id + 2)")
def missing_counterpart(spark, d):
    src = P.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.array(F.col("doc_id") + 1, F.col("doc_id") + 2).alias("candidates"))
    return C.without_counterpart(src, P.table(spark, d, "labels").select(F.col("doc_id").alias("path"))).select(F.col("path").alias("doc_id"))


OWN = """own AS (SELECT CAST(l_partkey AS VARCHAR) AS dir, CAST(l_suppkey AS VARCHAR) AS author, count(*) AS n, sum(exp(-ln(2.0::DOUBLE) / 180.0::DOUBLE * greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2001-08-02') - epoch(l_shipdate)) / 86400.0))) AS w FROM lineitem GROUP BY 1, 2),
 share AS (SELECT dir, author, n, 0.6 * n / sum(n) OVER (PARTITION BY dir) + CASE WHEN sum(w) OVER (PARTITION BY dir) > 0 THEN 0.4 * w / sum(w) OVER (PARTITION BY dir) ELSE 0 END AS s FROM own)"""


@query(f"WITH {OWN} SELECT dir, author, n AS lines, round(s, 6) AS share FROM share")
def ownership_share(spark, d):
    return C.ownership(P.ownership_rows(spark, d), ORDERS).select("dir", "author", "lines", r6("share").alias("share"))


@query(f"""WITH {OWN}, o AS (SELECT dir, author, round(s, 9) AS s FROM share), c AS (SELECT dir, row_number() OVER w AS rn, sum(s) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER (PARTITION BY dir) AS authors FROM o WINDOW w AS (PARTITION BY dir ORDER BY s DESC, author)),
 r AS (SELECT dir, coalesce(min(rn) FILTER (WHERE round(cum, 6) > 0.5), max(authors)) AS risk, max(authors) AS authors FROM c GROUP BY dir)
 SELECT dir, CAST(risk AS BIGINT) AS risk, authors, CASE WHEN risk <= 1 THEN 0.8 WHEN risk = 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence, CASE WHEN risk <= 1 THEN 'CRITICAL' WHEN risk = 2 THEN 'WARNING' ELSE 'ok' END AS level FROM r""")
def lottery_risk(spark, d):
    return C.lottery_risk(C.ownership(P.ownership_rows(spark, d), ORDERS))


@query("SELECT event_id, round(exp(-ln(2.0::DOUBLE) / 180.0::DOUBLE * greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2024-01-20') - epoch(ts)) / 86400.0)), 6) AS weight FROM events")
def recency_decay(spark, d):
    days = (F.unix_timestamp(F.lit("2024-01-20").cast("timestamp")).cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400.0
    return P.table(spark, d, "events").select("event_id", r6(X.decay(days)).alias("weight"))


@query(r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS path FROM pages),
 dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM p WHERE length(path) % 2 = 0)
 SELECT p.path, coalesce((SELECT dir FROM dirs WHERE starts_with(p.path, dir || '/') ORDER BY length(dir) DESC LIMIT 1), '.') AS owner FROM p""")
def longest_prefix_owner(spark, d):
    p = P.page_paths(spark, d).select("path").distinct()
    dirs = p.where(F.length("path") % 2 == 0).select(F.regexp_replace("path", r"/[^/]*$", "").alias("dir")).distinct()
    return C.longest_prefix(p, dirs)


@query("""WITH g AS (SELECT CAST(l_partkey AS VARCHAR) AS dir, CAST(l_suppkey AS VARCHAR) AS reviewer, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY dir) AS BIGINT) AS total FROM g)
 SELECT dir, reviewer, n, total, 0.6::DOUBLE AS confidence FROM t WHERE total >= 3 AND n > 0.1 * total""")
def review_concentration(spark, d):
    x = P.ownership_rows(spark, d).select("dir", F.col("author").alias("reviewer"))
    return C.review_concentration(x, 3, 0.1)


@query("WITH r AS (SELECT DISTINCT l_orderkey AS number, l_suppkey % 5 AS reviewer FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS number, CASE WHEN l_linenumber = 1 THEN '.' ELSE 'm' || (l_partkey % 3) END AS dir FROM lineitem) SELECT dir, CAST(reviewer AS VARCHAR) AS reviewer, count(*) AS n FROM r JOIN c USING (number) GROUP BY 1, 2")
def review_participation(spark, d):
    x = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("number"), (F.col("l_suppkey") % 5).cast("string").alias("reviewer"), F.when(F.col("l_linenumber") == 1, "a.go").otherwise(F.concat(F.lit("m"), (F.col("l_partkey") % 3).cast("string"), F.lit("/b.go"))).alias("path"))
    return C.review_rows(x, x).groupBy("dir", "reviewer").agg(F.count(F.lit(1)).alias("n"))


@query("WITH u AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, 'Contributor ' || CASE WHEN n < 26 THEN chr(CAST(65 + n AS INTEGER)) ELSE CASE WHEN n < 702 THEN '' WHEN n < 18278 THEN chr(CAST(65 + (n - 702) // 676 AS INTEGER)) ELSE chr(CAST(65 + (n - 18278) // 17576 AS INTEGER)) || chr(CAST(65 + (n - 18278) // 676 % 26 AS INTEGER)) END || CASE WHEN n < 702 THEN chr(CAST(64 + n // 26 AS INTEGER)) WHEN n < 18278 THEN chr(CAST(65 + (n - 702) // 26 % 26 AS INTEGER)) ELSE chr(CAST(65 + (n - 18278) // 26 % 26 AS INTEGER)) END || chr(CAST(65 + n % 26 AS INTEGER)) END AS label FROM u")
def anonymise_authors(spark, d):
    from pyspark.sql import Window

    u = P.table(spark, d, "events").select("user_id").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("user_id")) - 1)
    return u.select("user_id", X.contributor_label(F.col("n")).alias("label"))


SECRET_SQL = r"""CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'AWS access key' WHEN regexp_matches(text, 'gh[ps]_[A-Za-z0-9_]{36,}') THEN 'GitHub token' WHEN regexp_matches(text, '(?i)(?:api[_-]?key|secret[_-]?key|password)\s*[:=]\s*["''][^"'']{8,}') THEN 'generic secret'
 WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private key' WHEN regexp_matches(text, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}') THEN 'JSON web token' WHEN regexp_matches(text, '[a-z]+://[^/\s:@]+:[^/\s:@]+@') THEN 'credentials in URL' WHEN regexp_matches(text, '(?i)\b(?:api key|secret|token|password)\s*[:=]\s*\S{4,}') THEN 'assigned secret' END"""


@query(f"WITH {LINES}, s AS (SELECT path, line, {SECRET_SQL} AS secret FROM lines) SELECT path AS file_path, line, 'Possible ' || secret AS title FROM s WHERE secret IS NOT NULL")
def hygiene_secrets(spark, d):
    f = P.files(spark, d)
    x = C.hygiene(P.lines(f), f, C.SECRETS | C.MORE_SECRETS, least_entropy=99.0)
    return x.where("kind = 'committed-secret'").select("file_path", "line", "title")


@query(rf"""WITH {LINES}, s AS (SELECT path, line, text, CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{{16}}') OR regexp_matches(text, 'gh[ps]_[A-Za-z0-9_]{{36,}}') OR regexp_matches(text, '(?i)(?:api[_-]?key|secret[_-]?key|password)\s*[:=]\s*["''][^"'']{{8,}}') THEN 1 END AS secret FROM lines),
 lit AS (SELECT path, line, regexp_extract(text, '(?i)(?:key|token|secret|password)[a-z_]*\s*[:=]\s*["'']([^"'']{{16,}})["'']', 1) AS v FROM s WHERE secret IS NULL), ch AS (SELECT path, line, v, unnest(string_split(v, '')) AS c FROM lit WHERE v <> ''), cnt AS (SELECT path, line, v, c, count(*) AS m FROM ch GROUP BY ALL),
 ent AS (SELECT path, line FROM cnt GROUP BY path, line, v HAVING round(-sum(m / length(v)::DOUBLE * log2(m / length(v)::DOUBLE)), 9) >= 3.0),
 c AS (SELECT path FROM lines WHERE regexp_matches(text, '^(<{{7}}|={{7}}|>{{7}})\s') GROUP BY path), m AS (SELECT doc_id FROM documents WHERE len(string_split(text, chr(13) || chr(10))) > 2 AND len(string_split(text, chr(10))) - len(string_split(text, chr(13) || chr(10))) >= 2),
 n AS (SELECT 'committed-secret' AS kind, false AS by_entropy, count(*) AS n FROM s WHERE secret IS NOT NULL UNION ALL SELECT 'committed-secret', true, count(*) FROM ent UNION ALL SELECT 'merge-conflict-marker', false, count(*) FROM c UNION ALL SELECT 'mixed-line-endings', false, count(*) FROM m) SELECT * FROM n WHERE n > 0""")
def hygiene_counts(spark, d):
    f = P.files(spark, d)
    x = C.hygiene(P.lines(f), f, least_entropy=3.0)
    return x.groupBy("kind", F.col("title").startswith("High-entropy").alias("by_entropy")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(l, '\s+')) AS token FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)), k AS (SELECT token, length(token) AS n FROM t WHERE length(token) >= 24),
 c AS (SELECT token, n, unnest(string_split(token, '')) AS ch FROM k), g AS (SELECT token, n, ch, count(*) AS m FROM c GROUP BY ALL) SELECT token, round(-sum(m / n::DOUBLE * log2(m / n::DOUBLE)), 6) AS entropy FROM g GROUP BY token""")
def entropy_tokens(spark, d):
    return C.entropy_tokens(P.lines(P.files(spark, d)), 24)


@query("SELECT p_name AS var, min(p_brand) AS path, 0.5::DOUBLE AS confidence FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 3) GROUP BY p_name")
def env_var_drift(spark, d):
    p = P.table(spark, d, "part")
    return C.env_drift(p.select(F.col("p_name").alias("var"), F.col("p_brand").alias("path")), p.where("p_size < 3").select(F.col("p_name").alias("key")).distinct())


@query("WITH k AS (SELECT DISTINCT lower(n_name) AS key FROM nation), w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark) SELECT key, 0.4::DOUBLE AS confidence FROM k WHERE NOT EXISTS (SELECT 1 FROM w WHERE contains(word, key))")
def dead_keys(spark, d):
    k = P.table(spark, d, "nation").select(F.lower("n_name").alias("key")).distinct()
    w = P.table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    return C.dead_keys(k, w)


@query("SELECT p_name AS key, count(DISTINCT p_size) AS n_values, count(DISTINCT p_brand) AS n_files, min(CAST(p_size AS VARCHAR)) AS least_value, max(CAST(p_size AS VARCHAR)) AS greatest_value, 0.3::DOUBLE AS confidence FROM part GROUP BY p_name HAVING count(DISTINCT p_size) > 1 AND count(DISTINCT p_brand) > 1")
def inconsistent_defaults(spark, d):
    p = P.table(spark, d, "part")
    return C.inconsistent_defaults(p.select(F.col("p_brand").alias("file"), F.col("p_name").alias("key"), F.col("p_size").cast("string").alias("value")))


ROUTES = r"""p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS route FROM pages), g AS (SELECT page_id, regexp_replace(regexp_replace(lower(route), '(.)/+$', '\1'), '[0-9]+', '{param}', 'g') AS route FROM p WHERE NOT regexp_matches(route, '[\^$?*+\[(|]'))"""


@query(f"WITH {ROUTES} SELECT route, 'undocumented-route' AS kind, 0.6::DOUBLE AS confidence FROM g WHERE page_id % 5 <> 0 AND route NOT IN (SELECT route FROM g WHERE page_id % 5 = 0) GROUP BY 1 UNION ALL SELECT route, 'unimplemented-route', 0.5 FROM g WHERE page_id % 5 = 0 AND route NOT IN (SELECT route FROM g WHERE page_id % 5 <> 0) GROUP BY 1")
def route_drift(spark, d):
    # numbers are named parameters, in braces in the specification, after a colon in the code
    p = P.page_paths(spark, d).where(~F.col("path").rlike(r"[\^$?*+\[(|]"))
    named = lambda form: F.regexp_replace("path", "[0-9]+", form).alias("route")
    return C.route_drift(p.where("page_id % 5 = 0").select(named("{id}")), p.where("page_id % 5 <> 0").select(named(":n")))


@query(r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/v1/users/<int{id}>' WHEN 1 THEN '/v2/users/{userid}' ELSE '/v2/users/' || page_id END AS normal, CASE page_id % 3 WHEN 0 THEN '/v1/users/<int{param}>' WHEN 1 THEN '/v2/users/{param}' ELSE '/v2/users/' || page_id END AS general FROM pages""")
def route_generalise(spark, d):
    k = F.col("page_id") % 3
    raw = F.when(k == 0, "/V1/users/<int:id>/?q=1").when(k == 1, "/v2/Users/:userId#x").otherwise(F.concat(F.lit("/v2/users/"), F.col("page_id").cast("string")))
    return P.table(spark, d, "pages").select("page_id", X.normal_route(raw).alias("normal"), X.general_route(raw).alias("general"))


@query("WITH v AS (SELECT page_id % 2 AS side, page_id % 9 AS v FROM pages) SELECT DISTINCT v AS version, (SELECT max(v) FROM v WHERE side = 0) AS top, 0.7::DOUBLE AS confidence FROM v WHERE side = 1 AND v < (SELECT max(v) FROM v WHERE side = 0)")
def stale_api_version(spark, d):
    x = P.table(spark, d, "pages").select("page_id", F.concat(F.lit("/api/v"), (F.col("page_id") % 9).cast("string"), F.lit("/x")).alias("route"))
    return C.stale_versions(x.where("page_id % 2 = 0"), x.where("page_id % 2 = 1"))


@query(r"""WITH l AS (SELECT page_id AS doc, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages), k AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS path FROM pages)
 SELECT doc, target, 0.6::DOUBLE AS confidence FROM l WHERE target <> '' AND NOT regexp_matches(target, '^(https?://|mailto:|#)') AND regexp_replace(target, '[#?].*$', '') NOT IN (SELECT path FROM k)""")
def broken_links(spark, d):
    p = P.page_paths(spark, d)
    links = p.select(F.col("page_id").alias("doc"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return C.broken_links(links, p)


@query("""WITH g AS (SELECT o_custkey AS doc, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1), x AS (SELECT doc, CAST(floor((epoch(b) - epoch(a)) / 86400.0) AS BIGINT) AS days FROM g)
 SELECT doc, days, CASE WHEN days >= 730 THEN 0.7 WHEN days >= 365 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM x WHERE days >= 180""")
def stale_doc(spark, d):
    g = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.min("o_orderdate").alias("doc_ts"), F.max("o_orderdate").alias("source_ts"))
    return C.stale_docs(g)


@query("""WITH t AS (SELECT event_type || '/' || (event_id % 50) AS path FROM events), pr AS (SELECT DISTINCT event_type || '/' || k AS doc, event_type AS dir FROM events, (VALUES (1), (60)) v(k))
 SELECT doc, dir, (SELECT count(*) FROM t WHERE path = dir OR starts_with(path, dir || '/')) AS source_touches, 0::BIGINT AS doc_touches, 0.3::DOUBLE AS confidence FROM pr WHERE NOT EXISTS (SELECT 1 FROM t WHERE path = doc)""")
def doc_code_drift(spark, d):
    c = P.commits(spark, d)
    dirs = c.select(F.split("path", "/")[0].alias("dir")).distinct()
    pairs = dirs.select(F.explode(F.array(F.concat("dir", F.lit("/1")), F.concat("dir", F.lit("/60")))).alias("doc"), "dir")
    return C.doc_drift(c, pairs)


NORM = f"""{LINES}, n AS (SELECT path, line, trim(text, ' ') AS text FROM lines WHERE trim(text, ' ') <> '' AND NOT regexp_matches(trim(text, ' '), '^(//|#|/\\*|\\*|--|import |from |package |use )')),
 w AS (SELECT path, line AS start, concat_ws(chr(10), text, lead(text, 1) OVER o, lead(text, 2) OVER o, lead(text, 3) OVER o) AS win, lead(text, 3) OVER o AS l FROM n WINDOW o AS (PARTITION BY path ORDER BY line)), win AS (SELECT path, start, win FROM w WHERE l IS NOT NULL)"""


@query(f"WITH {NORM} SELECT path, start, sha256(win) AS window_id FROM win")
def clone_windows(spark, d):
    w = C.clone_windows(C.normalised_lines(P.lines(P.files(spark, d))), 4)
    return w.select("path", "start", F.sha2("window", 256).alias("window_id"))


@query(f"WITH {NORM} SELECT sha256(win) AS window_id, count(*) AS locations, min(path) AS path, round(0.35 + 0.10 * (4 - 6) / 8.0 + CASE WHEN count(*) >= 4 THEN 0.10 WHEN count(*) >= 3 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS confidence FROM win GROUP BY win HAVING count(*) >= 2")
def exact_clones(spark, d):
    w = C.clone_windows(C.normalised_lines(P.lines(P.files(spark, d))), 4)
    return C.clone_groups(w, 4).select("window_id", "locations", "path", r6("confidence").alias("confidence"))


KEEP = ", ".join(f"'{k}'" for k in C.KEYWORDS)
NEAR = f"""pieces AS (SELECT path, line, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_]') AND x NOT IN ({KEEP}) THEN '$' ELSE x END), '') AS text FROM n),
 nw AS (SELECT path, line AS start, concat_ws(chr(10), text, lead(text, 1) OVER o, lead(text, 2) OVER o, lead(text, 3) OVER o) AS win, lead(text, 3) OVER o AS l FROM pieces WINDOW o AS (PARTITION BY path ORDER BY line)), near AS (SELECT path, start, sha256(win) AS g FROM nw WHERE l IS NOT NULL)"""


@query(f"WITH {NORM}, {NEAR} SELECT g AS window_id, count(*) AS locations, round(0.30 + 0.10 * (4 - 6) / 8.0 + CASE WHEN count(*) >= 4 THEN 0.10 WHEN count(*) >= 3 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS confidence FROM near GROUP BY g HAVING count(*) >= 2")
def near_clones(spark, d):
    x = C.clone_windows(C.normalised_lines(P.lines(P.files(spark, d)), near=True), 4)
    return C.clone_groups(x, 4, near=True).select("window_id", "locations", r6("confidence").alias("confidence"))


@query("""SELECT n AS lines, k AS locations, round(least(CASE WHEN n >= 50 THEN 0.75 WHEN n >= 30 THEN 0.60 + 0.15 * (n - 30) / 19.0 WHEN n >= 15 THEN 0.45 + 0.15 * (n - 15) / 14.0 ELSE 0.35 + 0.10 * (n - 6) / 8.0 END + CASE WHEN k >= 4 THEN 0.10 WHEN k >= 3 THEN 0.05 ELSE 0 END, 0.8)::DOUBLE, 6) AS confidence
 FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) + 4 AS n, CAST(l_linenumber AS BIGINT) + 1 AS k FROM lineitem)""")
def clone_confidence(spark, d):
    x = P.table(spark, d, "lineitem").select((F.col("l_quantity").cast("long") + 4).alias("lines"), (F.col("l_linenumber").cast("long") + 1).alias("locations")).distinct()
    return x.withColumn("confidence", r6(X.clone_confidence(F.col("locations"), F.col("lines"), False)))


@query(f"""WITH RECURSIVE {NORM}, loc AS (SELECT w.path, w.line AS start, w.stop, sha256(w.win) AS g FROM (SELECT path, line, concat_ws(chr(10), text, lead(text, 1) OVER o, lead(text, 2) OVER o, lead(text, 3) OVER o) AS win, lead(line, 3) OVER o AS stop FROM n WINDOW o AS (PARTITION BY path ORDER BY line)) w WHERE stop IS NOT NULL),
 grp AS (SELECT g, count(*) AS n, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM loc GROUP BY g HAVING count(*) >= 2), pos AS (SELECT loc.*, grp.n, grp.paths FROM loc JOIN grp USING (g)),
 ed AS (SELECT DISTINCT a.g AS a, b.g AS b FROM pos a JOIN pos b ON a.path = b.path AND b.start > a.start AND b.start <= a.start + 4 AND a.n = b.n AND a.paths = b.paths AND a.g <> b.g), e2 AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
 r(id, c) AS (SELECT a, a FROM e2 UNION SELECT e2.b, r.c FROM r JOIN e2 ON r.id = e2.a), cc AS (SELECT id, min(c) AS c FROM r GROUP BY id), pl AS (SELECT coalesce(cc.c, pos.g) AS clone, pos.path, pos.start, pos.stop, pos.n FROM pos LEFT JOIN cc ON cc.id = pos.g),
 sp AS (SELECT clone, path, min(start) AS start, max(stop) AS stop, max(n) AS n FROM pl GROUP BY 1, 2), wh AS (SELECT clone, max(stop - start + 1) AS lines, max(n) AS locations FROM sp GROUP BY 1)
 SELECT clone, path, start, stop, lines, locations, round(least(CASE WHEN lines >= 50 THEN 0.75 WHEN lines >= 30 THEN 0.60 + 0.15 * (lines - 30) / 19.0 WHEN lines >= 15 THEN 0.45 + 0.15 * (lines - 15) / 14.0 ELSE 0.35 + 0.10 * (lines - 6) / 8.0 END + CASE WHEN locations >= 4 THEN 0.10 WHEN locations >= 3 THEN 0.05 ELSE 0 END, 0.8)::DOUBLE, 6) AS confidence FROM sp JOIN wh USING (clone)""")
def merged_clones(spark, d):
    return C.merged_clones(C.file_windows(P.files(spark, d), 4), 4).withColumn("confidence", r6("confidence"))


@query(f"""WITH RECURSIVE {NORM}, e AS (SELECT DISTINCT a.path AS a, b.path AS b FROM win a JOIN win b ON a.win = b.win AND a.path <> b.path), r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a) SELECT id, min(c) AS component FROM r GROUP BY id""")
def clone_components(spark, d):
    w = C.clone_windows(C.normalised_lines(P.lines(P.files(spark, d))), 4).select(F.sha2("window", 256).alias("g"), "path").distinct()
    lead = w.groupBy("g").agg(F.min("path").alias("a"))
    return G.components(w.join(lead, "g").select("a", F.col("path").alias("b")).where("a <> b"))


@query(f"""WITH {NORM}, {NEAR}, ex AS (SELECT path, start FROM win WHERE win IN (SELECT win FROM win GROUP BY win HAVING count(*) >= 2)),
 nr AS (SELECT * FROM near WHERE g IN (SELECT g FROM near GROUP BY g HAVING count(*) >= 2)), cov AS (SELECT DISTINCT path, start + k AS line FROM ex, range(4) t(k)), need AS (SELECT g, path, start + k AS line FROM nr, range(4) t(k))
 SELECT DISTINCT g AS window_id FROM need WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.path = need.path AND cov.line = need.line)""")
def clone_subtract(spark, d):
    from .plans.tables import written

    lines = P.lines(P.files(spark, d))
    windows = lambda near: written(C.clone_windows(C.normalised_lines(lines, near=near), 4).select(F.sha2("window", 256).alias("group"), "path", "start"))
    twice = lambda x: x.join(x.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("group"), "group")
    return C.subtract_exact(twice(windows(True)), twice(windows(False)), 4).select(F.col("group").alias("window_id"))


EDGES = """edges AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 HAVING count(*) * 60000 >= 200 * (SELECT count(*) FROM lineitem))"""


@query(f"WITH {EDGES} SELECT src, count(DISTINCT dst) AS n, round(CASE WHEN count(DISTINCT dst) >= 20 THEN 0.7 WHEN count(DISTINCT dst) >= 15 THEN 0.55 + 0.15 * (count(DISTINCT dst) - 15) / 4 WHEN count(DISTINCT dst) >= 10 THEN 0.4 + 0.15 * (count(DISTINCT dst) - 10) / 4 ELSE 0.0 END::DOUBLE, 6) AS confidence FROM edges WHERE src <> dst GROUP BY src HAVING count(DISTINCT dst) >= 2")
def fan_out(spark, d):
    return C.fan_out(P.nation_edges(spark, d), 2).withColumn("confidence", r6("confidence"))


@query(f"""WITH RECURSIVE {EDGES.replace(">= 200", ">= 170")}, r(src, dst) AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src AND e.src <> e.dst), m AS (SELECT a.src, least(min(a.dst), a.src) AS cycle FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
 SELECT cycle, count(*) AS size, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS members, CASE count(*) WHEN 2 THEN 0.8 WHEN 3 THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence FROM m GROUP BY cycle HAVING count(*) >= 2""")
def circular_deps(spark, d):
    return G.cycles(P.nation_edges(spark, d, 170))


SKIPPED = ", ".join(f"'{k}'" for k in C.SKIPPED_NAMES)


@query(f"""WITH {LINES}, t AS (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS token FROM lines), h AS (SELECT token, path, count(*) AS n FROM t GROUP BY 1, 2), f AS (SELECT token, count(*) AS files FROM h GROUP BY 1),
 s AS (SELECT DISTINCT path, regexp_extract(text, '^[A-Za-z0-9_]+') AS symbol FROM lines WHERE regexp_extract(text, '^[A-Za-z0-9_]+') <> '')
 SELECT s.symbol, s.path, false AS test_only FROM s JOIN h ON h.token = s.symbol AND h.path = s.path JOIN f ON f.token = s.symbol WHERE n = 1 AND files = 1 AND strlen(s.symbol) > 2 AND s.symbol NOT IN ({SKIPPED}) AND NOT regexp_matches(s.symbol, '^(Test|Benchmark|Example|test)') AND NOT (starts_with(s.symbol, '__') AND ends_with(s.symbol, '__'))""")
def dead_symbols(spark, d):
    # a dead symbol stands once: a word that begins two lines is none, and those of one line are one row each; no token goes past the end of a line
    f = P.files(spark, d)
    every = lambda pattern: F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))
    s = f.select("path", every("(?dm)^[A-Za-z0-9_]+").alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n = 1").select("path", "symbol")
    t = f.select("path", every("[A-Za-z0-9_]+").alias("token"))
    return C.dead_symbols(s, t)


COMPLEX = f"""{LINES}, blk AS (SELECT path, count(*) AS n, CAST(sum(length(text) - length(replace(text, ',', ''))) AS BIGINT) AS branches FROM lines GROUP BY path), cx AS (SELECT path, n AS lines, branches, n / 50.0::DOUBLE + branches AS score FROM blk WHERE n / 50.0::DOUBLE + branches >= 6)"""


@query(f"WITH {COMPLEX} SELECT path, lines, branches, round(score, 6) AS score, round(CASE WHEN score >= 15 THEN 0.8 WHEN score >= 8 THEN 0.6 + 0.2 * (score - 8) / 7 ELSE 0.5 + 0.1 * (score - 6) / 2 END, 6) AS confidence FROM cx")
def complexity_score(spark, d):
    return _complexity(spark, d).select("path", "lines", "branches", r6("score").alias("score"), r6("confidence").alias("confidence"))


def _complexity(spark, d):
    f = P.files(spark, d)
    b = f.select("path", F.lit("document").alias("name"), F.size(F.split(F.regexp_replace("content", r"\n$", ""), "\n")).cast("long").alias("lines"), F.col("content").alias("text"))
    return C.complexity(b, branch=",")


@query(f"""WITH {COMPLEX}, {CHURN}, c2 AS (SELECT 'src' || (CAST(split_part(path, '/', 2) AS INTEGER) % 20) || '/' || split_part(path, '/', 2) || '.md' AS path, CAST(sum(changes) AS BIGINT) AS changes FROM churn GROUP BY 1)
 SELECT path, 'document' AS name, round(score, 6) AS score, changes, round(log2(changes + 1) * score, 6) AS heat FROM cx JOIN c2 USING (path) WHERE changes >= 5 ORDER BY heat DESC, path LIMIT 15""")
def hotspots(spark, d):
    c = C.churn(P.commits(spark, d), NOW, least=1)
    k = F.split("path", "/")[1]
    c = c.groupBy(F.concat(F.lit("src"), (k.cast("int") % 20).cast("string"), F.lit("/"), k, F.lit(".md")).alias("path")).agg(F.sum("changes").alias("changes"))
    return R.hotspots(_complexity(spark, d), c).withColumn("score", r6("score"))


@query(f"WITH {CHURN} SELECT path, changes, authors, CASE WHEN changes >= 20 THEN 'unstable' WHEN changes >= 10 THEN 'moderate' ELSE 'stable' END AS stability FROM churn ORDER BY changes DESC, path LIMIT 20")
def churn_section(spark, d):
    return R.churn_section(C.churn(P.commits(spark, d), NOW, least=1))


SCAN = f"""{MARK}, touched AS (SELECT 'src' || (event_id % 50 % 20) || '/' || (event_id % 50) || '.md' AS path, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 90 DAY GROUP BY 1 HAVING count(*) >= 10),
 long AS (SELECT path, count(*) AS n FROM lines GROUP BY path HAVING count(*) > 20),
 raw AS (SELECT * FROM markers UNION ALL SELECT 'gitlog', 'churn', path, 0, 'High churn: ' || path || ' (modified ' || n || ' times in 90 days)', CASE WHEN n >= 30 THEN 0.8 ELSE 0.4 + (n - 10) / 20.0 * 0.4 END::DOUBLE FROM touched
  UNION ALL SELECT 'patterns', 'large-file', path, 0, 'Large file: ' || path || ' (' || n || ' lines)', least(0.4 + 0.4 * (n / 20.0 - 1), 0.8)::DOUBLE FROM long),
 one AS (SELECT {ID} AS signal_id, source, kind, file_path, line, title, max(confidence) AS c FROM raw WHERE trim(title) <> '' GROUP BY ALL),
 scan AS (SELECT signal_id, source, kind, file_path, line, title, round(least(1.0, c + CASE WHEN kind <> 'churn' AND file_path IN (SELECT path FROM touched) THEN 0.05 ELSE 0 END), 6)::DOUBLE AS confidence FROM one)"""


def scanned(spark: SparkSession, d: str, **how) -> DataFrame:
    roles = {"files": P.files(spark, d), "commits": P.touched_documents(spark, d)}
    o = N.Options(now=NOW, markers={k.upper(): v for k, v in WORDS.items()}, comment=r"\b", large_lines=20)
    return N.scan(roles, o, names=N.chosen(include=("todos", "gitlog", "patterns")), **how).withColumn("confidence", r6("confidence"))


@query(f"WITH {SCAN} SELECT * FROM scan")
def scan_signals(spark, d):
    return scanned(spark, d).select("signal_id", "source", "kind", "file_path", "line", "title", "confidence")


@query(f"WITH {SCAN} SELECT signal_id, file_path, line, confidence FROM scan WHERE regexp_matches(file_path, '^(.*/)?src1/.*$') AND confidence >= 0.45 ORDER BY {PRIO}, confidence DESC, file_path, line, title LIMIT 10")
def scan_restricted(spark, d):
    x = scanned(spark, d, confidence=0.45).where(F.col("file_path").rlike(r"^(?:.*/)?src1/.*$"))
    return S.capped(x, 10, ["file_path", "line", "title"]).select("signal_id", "file_path", "line", "confidence")


@query(f"WITH {SCAN}, s AS (SELECT *, split_part(file_path, '/', 1) AS module, {PRIO} AS p FROM scan), g AS (SELECT module, count(*) AS total, count(*) FILTER (WHERE p = 1) AS p1, count(*) FILTER (WHERE p = 2) AS p2, count(*) FILTER (WHERE p = 3) AS p3, count(*) FILTER (WHERE p = 4) AS p4 FROM s GROUP BY module),"
       " k AS (SELECT module, kind, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC, kind) AS rn FROM s GROUP BY module, kind), t AS (SELECT module, string_agg(kind, ',' ORDER BY rn) AS top_kinds FROM k WHERE rn <= 3 GROUP BY module)"
       " SELECT module, total, p1, p2, p3, p4, 4 * p1 + 3 * p2 + 2 * p3 + p4 AS health, top_kinds FROM g JOIN t USING (module) ORDER BY health DESC, module LIMIT 20")
def module_summary(spark, d):
    return R.module_summary(scanned(spark, d))


@query(f"WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS source, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'a/b.go' END AS file_path, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS line, CAST(user_id AS VARCHAR) AS title FROM events) SELECT event_id, {ID} AS signal_id FROM e")
def signal_ids(spark, d):
    k = F.col("event_id")
    e = P.table(spark, d, "events").select(k, F.when(k % 5 == 0, None).otherwise(F.col("event_type")).alias("source"), F.col("event_type").alias("kind"), F.when(k % 3 == 0, None).otherwise("a/b.go").alias("file_path"), F.when(k % 7 == 0, None).otherwise(k).alias("line"), F.col("user_id").cast("string").alias("title"))
    return S.with_id(e).select("event_id", "signal_id")


DEMO = ("examples/", "x/demo/", "docs/a/", "lib/", "")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'examples/' WHEN 1 THEN 'x/demo/' WHEN 2 THEN 'docs/a/' WHEN 3 THEN 'lib/' ELSE '' END || event_id || '.go' AS file_path, CASE WHEN event_id % 2 = 0 THEN 'missing-tests' ELSE 'churn' END AS kind FROM events WHERE event_id % 5 >= 3 OR event_id % 2 = 1")
def demo_suppression(spark, d):
    k = F.col("event_id")
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in DEMO]), (k % 5 + 1).cast("int")), k.cast("string"), F.lit(".go"))
    x = P.table(spark, d, "events").select(k, path.alias("file_path"), F.when(k % 2 == 0, "missing-tests").otherwise("churn").alias("kind"))
    return N.without_demos(x)


CODE = "c AS (SELECT CAST(p_partkey AS BIGINT) AS k, 'app.m' || (p_partkey % 7) || '.f' || p_partkey AS m, 'app/m' || (p_partkey % 7) || '/f' || p_partkey || '.py' AS path FROM part)"


@query(f"WITH {CODE} SELECT DISTINCT a.m AS src, b.m AS dst FROM c a JOIN c b ON (b.k = a.k + 1 OR b.k = 3 * a.k) AND a.k <> b.k")
def import_edges(spark, d):
    return Y.import_edges(N.lines_of(P.code_files(spark, d)))


@query(f"WITH {CODE}, e AS (SELECT DISTINCT a.m AS src, b.m AS dst FROM c a JOIN c b ON (b.k = a.k + 1 OR b.k = 3 * a.k) AND a.k <> b.k) SELECT 'coupling' AS source, 'high-coupling' AS kind, src AS file_path, 'High coupling: ' || src || ' imports ' || count(*) || ' modules' AS title FROM e GROUP BY src HAVING count(*) >= 2")
def coupling_signals(spark, d):
    x = N.coupling({"files": P.code_files(spark, d)}, N.Options(fan_out=2, cycles=False))[0]
    return x.select("source", "kind", "file_path", "title")


@query(f"WITH {CODE} SELECT path, 'run_' || k AS name, 4 AS start, 10 AS stop, 5::BIGINT AS lines, 2::BIGINT AS branches, 2.1::DOUBLE AS score FROM c")
def function_extraction(spark, d):
    return Y.functions(P.code_files(spark, d)).withColumn("score", r6("score"))


@query(f"WITH {CODE} SELECT 'unused-function' AS kind, path AS file_path, 4 AS line, 'Unused function: run_' || k AS title, 0.4::DOUBLE AS confidence FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.k % 3 = 0 AND o.k + 1 = c.k) UNION ALL SELECT 'unused-type', path, 11, 'Unused type: Kind' || k, 0.4 FROM c")
def dead_code_signals(spark, d):
    return N.deadcode({"files": P.code_files(spark, d)}, N.Options())[0].select("kind", "file_path", "line", "title", "confidence")


@query(rf"""WITH {LINES}, s AS (SELECT path, {SECRET_SQL} AS secret FROM lines), c AS (SELECT path FROM lines WHERE regexp_matches(text, '^(<{{7}}|={{7}}|>{{7}})\s') GROUP BY path), m AS (SELECT source || '/' || doc_id FROM documents WHERE len(string_split(text, chr(13) || chr(10))) > 2 AND len(string_split(text, chr(10))) - len(string_split(text, chr(13) || chr(10))) >= 2),
 n AS (SELECT 'Large binaries' AS issue, 0::BIGINT AS n UNION ALL SELECT 'Merge conflict markers', count(*) FROM c UNION ALL SELECT 'Committed secrets', count(*) FROM s WHERE secret IS NOT NULL UNION ALL SELECT 'Mixed line endings', count(*) FROM m) SELECT * FROM n UNION ALL SELECT 'Total', CAST(sum(n) AS BIGINT) FROM n""")
def hygiene_section(spark, d):
    f = P.files(spark, d)
    return R.hygiene_section(C.hygiene(P.lines(f), f, C.SECRETS | C.MORE_SECRETS, least_entropy=99.0))


@query(f"WITH {MARK}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY file_path, line, title) AS rn, count(*) OVER (PARTITION BY kind) AS n FROM markers) SELECT kind, max(n) AS n, string_agg(title || ' (' || file_path || ':' || line || ')', '; ' ORDER BY rn) AS examples FROM r WHERE rn <= 5 GROUP BY kind")
def debt_by_kind(spark, d):
    return R.debt_by_kind(marker_signals(spark, d))


@query("WITH m AS (SELECT l_orderkey AS number, CASE l_linenumber % 3 WHEN 0 THEN 'a.go' WHEN 1 THEN 'cmd/x.go' ELSE 'internal/m' || (l_partkey % 3) || '/y.go' END AS path FROM lineitem), k AS (SELECT number, CASE WHEN path = 'a.go' THEN '.' WHEN path = 'cmd/x.go' THEN 'cmd' ELSE regexp_replace(path, '/y.go$', '') END AS module, count(*) AS n FROM m GROUP BY 1, 2) SELECT number, 'Modules affected: ' || string_agg(module || ' (' || n || CASE WHEN n = 1 THEN ' file)' ELSE ' files)' END, ', ' ORDER BY module) AS context FROM k GROUP BY number")
def modules_affected(spark, d):
    k = F.col("l_linenumber") % 3
    path = F.when(k == 0, "a.go").when(k == 1, "cmd/x.go").otherwise(F.concat(F.lit("internal/m"), (F.col("l_partkey") % 3).cast("string"), F.lit("/y.go")))
    return R.modules_affected(P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("number"), path.alias("path")))


@query("SELECT count(*) AS assigned, count(*) FILTER (WHERE substr(o_orderpriority, 1, 1) = '1') AS p1, count(DISTINCT o_orderpriority) AS distinct, '' AS warning FROM orders")
def priority_check(spark, d):
    return R.priority_check(P.table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("priority")))


@query("SELECT user_id % 10 AS cluster, count(*) AS n, max((event_id % 10) / 10.0)::DOUBLE AS confidence, list_sort(list_distinct(list(event_type))) AS tags FROM events GROUP BY 1")
def merged_clusters(spark, d):
    x = P.table(spark, d, "events").select((F.col("user_id") % 10).alias("cluster"), ((F.col("event_id") % 10) / 10.0).alias("confidence"), F.array("event_type").alias("tags"))
    return R.merged_clusters(x)


@query(f"WITH {OWN}, r AS (SELECT dir, author, s, row_number() OVER (PARTITION BY dir ORDER BY round(s, 9) DESC, author) AS rn FROM share) SELECT dir, string_agg(author || ' ' || CAST(round(100 * round(s, 9)) AS INTEGER) || '%', ', ' ORDER BY rn) AS contributors FROM r WHERE rn <= 3 GROUP BY dir")
def owners_section(spark, d):
    o = C.ownership(P.ownership_rows(spark, d), ORDERS).withColumn("share", F.round("share", 9))
    return R.owners_section(o)


@query("WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS signal_id FROM orders), e AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS f, CAST(l_orderkey + l_linenumber AS VARCHAR) AS t FROM lineitem WHERE l_returnflag = 'R'), k AS (SELECT * FROM e WHERE t IN (SELECT signal_id FROM s)), b AS (SELECT f AS signal_id, string_agg(t, ',' ORDER BY t) AS blocks FROM k GROUP BY 1), p AS (SELECT t AS signal_id, string_agg(f, ',' ORDER BY f) AS depends_on FROM k GROUP BY 1) SELECT signal_id, coalesce(blocks, '') AS blocks, coalesce(depends_on, '') AS depends_on FROM s LEFT JOIN b USING (signal_id) LEFT JOIN p USING (signal_id)")
def dependency_joins(spark, d):
    s = P.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("signal_id"))
    kind = F.when(F.col("l_returnflag") == "R", "blocks").otherwise("relates-to")
    e = P.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("from_id"), (F.col("l_orderkey") + F.col("l_linenumber")).cast("string").alias("to_id"), kind.alias("type"))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return D.with_dependencies(s, e).select("signal_id", text("blocks"), text("depends_on"))


@query("SELECT o_orderkey AS number, CASE WHEN o_orderkey % 3 = 0 THEN 'github-closed-issue' WHEN o_orderstatus = 'F' THEN 'github-merged-pr' ELSE 'github-closed-pr' END AS kind, CASE WHEN o_orderkey % 3 <> 0 AND o_orderstatus <> 'F' THEN 0.2 ELSE 0.3 END::DOUBLE AS confidence FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderdate >= DATE '1998-01-01'")
def closed_items(spark, d):
    o = P.table(spark, d, "orders")
    closed = F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.col("o_orderdate").cast("timestamp"))
    x = o.select(F.col("o_orderkey").alias("number"), (F.col("o_orderkey") % 3 != 0).alias("pull"), (F.col("o_orderstatus") == "F").alias("merged"), closed.alias("closed"))
    return C.closed_items(x, "1998-01-01 00:00:00").drop("tags")


@query("SELECT p_partkey, CASE WHEN n >= 1000000000 THEN printf('%.1f GB', n / 1e9) WHEN n >= 1000000 THEN printf('%.1f MB', n / 1e6) WHEN n >= 1000 THEN printf('%.1f KB', n / 1e3) ELSE n || ' B' END AS size FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1004 WHEN 2 THEN 1000003 ELSE 1000000007 END AS n FROM part)")
def human_size(spark, d):
    k = F.col("p_partkey") % 4
    n = F.col("p_size").cast("long") * F.when(k == 0, 1).when(k == 1, 1004).when(k == 2, 1000003).otherwise(1000000007)
    return P.table(spark, d, "part").select("p_partkey", X.human_size(n).alias("size"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/c' WHEN 1 THEN '../b' WHEN 2 THEN '.' ELSE 'x/' || doc_id END AS path FROM documents")
def clean_paths(spark, d):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, "a/./b/../c/").when(k == 1, "a/../../b").when(k == 2, "a/b/../..").otherwise(F.concat(F.lit("./x//"), F.col("doc_id").cast("string")))
    return P.table(spark, d, "documents").select("doc_id", X.clean_path(raw).alias("path"))


@query("""WITH x AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE greatest(0, (epoch(TIMESTAMP '2001-08-02') - epoch(o_orderdate)) / 86400.0) END AS days FROM orders), b AS (SELECT CASE WHEN days IS NULL THEN 'unknown' WHEN days >= 365 THEN '> 1 year' WHEN days >= 90 THEN '3-12 months' WHEN days >= 28 THEN '1-3 months' WHEN days >= 7 THEN '1-4 weeks' ELSE '< 1 week' END AS bucket FROM x)
 SELECT CAST(ord AS INTEGER) AS ord, v.bucket, count(b.bucket) AS n FROM (VALUES (0, '< 1 week'), (1, '1-4 weeks'), (2, '1-3 months'), (3, '3-12 months'), (4, '> 1 year'), (5, 'unknown')) v(ord, bucket) LEFT JOIN b USING (bucket) GROUP BY ALL""")
def todo_age_buckets(spark, d):
    o = P.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderdate")).alias("ts"))
    return R.age_buckets(o, ORDERS)


@query("""WITH m AS (SELECT 'churn' AS rule, count(DISTINCT event_type) AS value FROM events UNION ALL SELECT 'todos', count(*) FROM documents UNION ALL SELECT 'coverage', 0 UNION ALL SELECT 'lottery-risk', count(*) FROM region)
 SELECT CAST(CASE rule WHEN 'lottery-risk' THEN 1 WHEN 'churn' THEN 2 ELSE 3 END AS INTEGER) AS severity, rule, value, 'Look into ' || value || ' ' || rule AS message FROM m WHERE value > 0""")
def recommendations(spark, d):
    one = lambda rule, t, c: P.table(spark, d, t).agg(F.lit(rule).alias("rule"), c.alias("value"))
    m = one("churn", "events", F.countDistinct("event_type")).union(one("todos", "documents", F.count(F.lit(1)))).union(one("coverage", "region", F.lit(0).cast("long"))).union(one("lottery-risk", "region", F.count(F.lit(1))))
    return R.recommendations(m)


DAILY = "daily AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2)"


@query(f"WITH {DAILY} SELECT day, key, n FROM daily UNION ALL SELECT day, 'total', CAST(sum(n) AS BIGINT) FROM daily GROUP BY day")
def history_daily(spark, d):
    return _daily(spark, d).withColumnRenamed("at", "day")


def _daily(spark, d):
    e = P.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("at"), F.col("event_type").alias("key"))
    return e.rollup("at", "key").agg(F.count(F.lit(1)).alias("n"), F.grouping("at").alias("g")).where("g = 0").select("at", F.coalesce("key", F.lit("total")).alias("key"), "n")


@query(f"""WITH {DAILY}, h AS (SELECT * FROM daily UNION ALL SELECT day, 'total', CAST(sum(n) AS BIGINT) FROM daily GROUP BY day), l AS (SELECT DISTINCT day FROM h ORDER BY day DESC LIMIT 5), e AS (SELECT min(day) AS a, max(day) AS b FROM l),
 g AS (SELECT key, CAST(coalesce(sum(n) FILTER (WHERE day = (SELECT a FROM e)), 0) AS BIGINT) AS old, CAST(coalesce(sum(n) FILTER (WHERE day = (SELECT b FROM e)), 0) AS BIGINT) AS new FROM h WHERE day IN ((SELECT a FROM e), (SELECT b FROM e)) GROUP BY key)
 SELECT key, old, new, new - old AS delta, CASE WHEN abs(new - old) / (CASE WHEN old = 0 THEN new ELSE old END)::DOUBLE < 0.1 THEN 'stable' WHEN new > old THEN 'degrading' ELSE 'improving' END AS direction FROM g""")
def trends(spark, d):
    return D.trends(_daily(spark, d))


def _snapshots(spark, d):
    s = S.with_id(C.markers(P.lines(P.files(spark, d)), {k.upper(): v for k, v in WORDS.items()}, prefix=r"\b"))
    k = F.pmod(F.regexp_extract("file_path", r"/(\d+)\.md$", 1).cast("long"), F.lit(7))
    before = s.where(k != 3).withColumn("line", F.when(k == 5, F.col("line") + 1).otherwise(F.col("line")))
    return s.where(k != 1), S.with_id(before)


SNAP = f"""{MARK}, k AS (SELECT *, CAST(regexp_extract(file_path, '/(\\d+)\\.md$', 1) AS BIGINT) % 7 AS k FROM markers), n AS (SELECT *, {ID} AS signal_id FROM k WHERE k <> 1), b0 AS (SELECT source, kind, file_path, CAST(CASE WHEN k = 5 THEN line + 1 ELSE line END AS INTEGER) AS line, title FROM k WHERE k <> 3), b AS (SELECT *, {ID} AS signal_id FROM b0)"""


@query(f"WITH {SNAP} SELECT signal_id, file_path, line FROM n WHERE signal_id NOT IN (SELECT signal_id FROM b)")
def delta_new(spark, d):
    n, b = _snapshots(spark, d)
    return D.new_signals(n, b).select("signal_id", "file_path", "line")


@query(f"WITH {SNAP} SELECT signal_id, file_path, line, 'added' AS change FROM n WHERE signal_id NOT IN (SELECT signal_id FROM b) UNION ALL SELECT signal_id, file_path, line, 'removed' FROM b WHERE signal_id NOT IN (SELECT signal_id FROM n)")
def diff_added_removed(spark, d):
    return D.differences(*_snapshots(spark, d)).select("signal_id", "file_path", "line", "change")


@query(f"""WITH {SNAP}, a AS (SELECT *, row_number() OVER (PARTITION BY kind, title ORDER BY file_path, line, source) AS rn FROM n WHERE signal_id NOT IN (SELECT signal_id FROM b)), r AS (SELECT *, row_number() OVER (PARTITION BY kind, title ORDER BY file_path, line, source) AS rn FROM b WHERE signal_id NOT IN (SELECT signal_id FROM n))
 SELECT r.kind, r.title, r.file_path AS from_path, r.line AS from_line, a.file_path AS to_path, a.line AS to_line FROM r JOIN a USING (kind, title, rn) WHERE r.file_path <> a.file_path OR r.line <> a.line""")
def diff_moved(spark, d):
    return D.moved(D.differences(*_snapshots(spark, d)))


@query(f"WITH {SNAP}, r AS (SELECT * FROM b WHERE signal_id NOT IN (SELECT signal_id FROM n)) SELECT file_path, line, kind, CASE WHEN file_path IN (SELECT source || '/' || doc_id || '.md' FROM documents WHERE doc_id % 2 = 0) THEN 'resolved' ELSE 'resolved: file deleted' END AS description, 0.3::DOUBLE AS confidence FROM r")
def resolved_signals(spark, d):
    n, b = _snapshots(spark, d)
    f = P.files(spark, d).where(F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("long") % 2 == 0)
    return D.resolved(b.join(n.select("signal_id"), "signal_id", "left_anti"), f).select("file_path", "line", "kind", "description", "confidence")


def _baseline(spark, d):
    t = F.lit("2024-01-01").cast("timestamp")
    return P.table(spark, d, "labels").select(F.col("doc_id").alias("signal_id"), F.when(F.col("toxic") == 1, "won't fix").otherwise("accepted").alias("reason"), t.alias("suppressed_at"), F.when(F.col("doc_id") % 3 == 0, F.lit("2024-01-15").cast("timestamp")).when(F.col("doc_id") % 3 == 1, F.lit("2024-06-01").cast("timestamp")).alias("expires_at"))


@query("SELECT doc_id AS signal_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0)")
def baseline_filter(spark, d):
    return D.unsuppressed(P.table(spark, d, "documents").select(F.col("doc_id").alias("signal_id")), _baseline(spark, d), NOW)


@query("SELECT CASE WHEN toxic = 1 THEN 'won''t fix' ELSE 'accepted' END AS reason, count(*) AS total, count(*) FILTER (WHERE doc_id % 3 = 0) AS expired FROM labels GROUP BY 1")
def baseline_status(spark, d):
    return D.baseline_status(_baseline(spark, d), NOW).select("reason", "total", "expired")


@query("SELECT doc_id AS signal_id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0) THEN 'none' ELSE (SELECT CASE WHEN toxic = 1 THEN 'won''t fix' ELSE 'accepted' END FROM labels l WHERE l.doc_id = d.doc_id) END AS suppression FROM documents d")
def suppress_annotate(spark, d):
    a = D.active(_baseline(spark, d), NOW).select("signal_id", "reason")
    return P.table(spark, d, "documents").select(F.col("doc_id").alias("signal_id")).join(a, "signal_id", "left").select("signal_id", F.coalesce("reason", F.lit("none")).alias("suppression"))


@query("""WITH s AS (SELECT p_partkey, substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS signal_id, p_name AS title FROM part), b AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'str-' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) ELSE 'x-1' END AS id, CASE WHEN p_partkey % 2 = 1 THEN 'TODO: ' || upper(p_name) ELSE '' END AS title FROM part WHERE p_partkey % 40 IN (0, 1))
 SELECT p_partkey, signal_id FROM s WHERE 'str-' || signal_id NOT IN (SELECT id FROM b) AND lower(title) NOT IN (SELECT replace(lower(title), 'todo: ', '') FROM b)""")
def backlog_dedup(spark, d):
    p = P.table(spark, d, "part")
    h = F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 8)
    b = p.where("p_partkey % 40 in (0, 1)").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("str-"), h)).otherwise("x-1").alias("id"), F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("TODO: "), F.upper("p_name"))).otherwise("").alias("title"))
    return D.beyond_backlog(p.select("p_partkey", h.alias("signal_id"), F.col("p_name").alias("title")), b).select("p_partkey", "signal_id")


@query("SELECT doc_id AS signal_id FROM labels WHERE toxic = 1 AND doc_id % 3 = 0")
def suppression_list(spark, d):
    return D.listed(_baseline(spark, d), NOW, "won't fix", expired_only=True).select("signal_id")


@query(f"WITH {COMPLEX}, {CHURN}, c2 AS (SELECT 'src' || (CAST(split_part(path, '/', 2) AS INTEGER) % 20) || '/' || split_part(path, '/', 2) || '.md' AS path, CAST(sum(changes) AS BIGINT) AS changes FROM churn GROUP BY 1) SELECT count(*) AS n FROM cx JOIN c2 USING (path) WHERE changes >= 5")
def hotspot_count(spark, d):
    c = P.touched_documents(spark, d).where("ts > timestamp'2024-01-31' - interval 90 days").groupBy("path").agg(F.count(F.lit(1)).alias("changes"))
    return R.hotspot_count(_complexity(spark, d), c)


@query("""WITH c AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS sha, ts FROM events), t AS (SELECT 'v' || event_id AS name, substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS short, ts FROM events WHERE event_id % 500 = 0),
 w AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS commits, count(*) FILTER (WHERE substr(sha, 1, 8) IN (SELECT short FROM t)) AS tagged FROM c GROUP BY 1), g AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, string_agg(name, ',' ORDER BY name) AS tags FROM t GROUP BY 1)
 SELECT week, commits, tagged, coalesce(tags, '') AS tags FROM w LEFT JOIN g USING (week)""")
def tagged_weeks(spark, d):
    e = P.table(spark, d, "events").select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("sha"), "ts")
    tags = e.where("event_id % 500 = 0").select(F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("name"), "sha", "ts")
    return R.tagged_weeks(e.select("sha", "ts"), tags).withColumn("week", F.col("week").cast("timestamp_ntz"))


@query("SELECT regexp_extract(replace(p_brand, '#', '-'), '^([A-Za-z]+)-', 1) AS prefix, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, prefix LIMIT 1")
def conventions(spark, d):
    return R.conventions(P.table(spark, d, "part").select(F.regexp_replace("p_brand", "#", "-").alias("id")))


@query("SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS commits, count(DISTINCT user_id) AS authors FROM events GROUP BY 1")
def weekly_activity(spark, d):
    return R.weekly(P.commits(spark, d)).withColumn("week", F.col("week").cast("timestamp_ntz"))


@query("SELECT CAST(user_id AS VARCHAR) AS author, count(*) AS commits FROM events GROUP BY 1 ORDER BY commits DESC, author LIMIT 10")
def top_authors(spark, d):
    return R.top_authors(P.commits(spark, d))


@query(f"WITH {MARK} SELECT source, CAST({PRIO} AS BIGINT) AS priority, count(*) AS n FROM markers GROUP BY 1, 2")
def priority_histogram(spark, d):
    return R.priority_histogram(marker_signals(spark, d))


@query("WITH x AS (SELECT conv_id AS thread, turn AS nth, text FROM conversations WHERE regexp_matches(text, '(?i)\\b(the|und|les)\\b')), r AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY nth, text) AS rn FROM x) SELECT thread, nth, 0.6::DOUBLE AS confidence FROM r WHERE rn <= 2")
def actionable_comments(spark, d):
    c = P.table(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("nth"), "text")
    return C.actionable(c, r"(?i)\b(?:the|und|les)\b", 2)


@query("""WITH x AS (SELECT o_orderkey AS number, CASE WHEN o_orderpriority LIKE '1%' THEN 'github-bug' WHEN o_orderpriority LIKE '2%' THEN 'github-feature' ELSE 'github-issue' END AS k, epoch(TIMESTAMP '2001-08-02') - epoch(o_orderdate) AS age FROM orders)
 SELECT number, CASE WHEN age / 86400.0 > 180 AND number % 2 = 0 THEN 'github-stale-issue' ELSE k END AS kind, CASE WHEN age / 86400.0 > 180 AND number % 2 = 0 THEN 0.2 ELSE round(CASE k WHEN 'github-bug' THEN 0.7 WHEN 'github-feature' THEN 0.5 ELSE 0.4 END + CASE WHEN age / 86400.0 > 90 THEN 0.1 ELSE 0 END, 6) END::DOUBLE AS confidence FROM x""")
def issue_classify(spark, d):
    o = P.table(spark, d, "orders")
    label = F.when(F.col("o_orderpriority").startswith("1"), "Bug").when(F.col("o_orderpriority").startswith("2"), "feature").otherwise("other")
    x = o.select(F.col("o_orderkey").alias("number"), F.array(label).alias("labels"), F.col("o_orderdate").alias("created"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).otherwise(F.lit(ORDERS).cast("timestamp")).alias("updated"))
    return C.issues(x, ORDERS)


@query(r"""WITH t AS (SELECT DISTINCT p_name AS title FROM part), w AS (SELECT title, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{Nd}]+'), lambda x: strlen(x) >= 2 AND x NOT IN ('a','an','the','is','it','in','of','to','and','or','for','on','at','by','with','this','that','from','as','be'))) AS ws FROM t)
 SELECT a.title AS a, b.title AS b, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE, 6) AS similarity FROM w a JOIN w b ON a.title < b.title WHERE len(list_intersect(a.ws, b.ws)) > 0 AND round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE, 6) >= 0.3""")
def jaccard_titles(spark, d):
    t = P.table(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("title")).distinct()
    return M.similar_titles(t, 0.3)


@query(None)
def leader_groups(spark, d):
    x = P.table(spark, d, "part").select(F.col("p_type").alias("part"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"))
    return M.leader_groups(x)


@query("""WITH v AS (SELECT DISTINCT event_type AS value FROM events), a AS (SELECT unnest(['sign-up', 'views', 'err', 'clicks', 'buy']) AS s), x AS (SELECT value, s, levenshtein(lower(value), s) AS k, row_number() OVER (PARTITION BY value ORDER BY levenshtein(lower(value), s), s) AS rn FROM v, a)
 SELECT value, CAST(k AS BIGINT) AS distance, CASE WHEN k <= 3 THEN s END AS suggestion FROM x WHERE rn = 1""")
def closest_enum(spark, d):
    return M.closest(P.table(spark, d, "events").select(F.col("event_type").alias("value")).distinct(), ["sign-up", "views", "err", "clicks", "buy"])


VECTOR = "CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'CVSS:3.1/AV:N/C:H/I:N/A:N' WHEN 2 THEN 'CVSS:3.1/AV:N/C:N/I:L/A:N' ELSE 'CVSS:3.1/AV:N/C:N/I:N/A:N' END"


@query(f"WITH v AS (SELECT DISTINCT l_linenumber % 4 AS k, {VECTOR} AS vector FROM lineitem) SELECT vector, CASE k WHEN 0 THEN 'unknown' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, CASE k WHEN 0 THEN 0.8 WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM v")
def vuln_severity(spark, d):
    v = P.table(spark, d, "lineitem").select(F.expr(VECTOR).alias("vector")).distinct()
    return v.select("vector", X.cvss_severity(F.col("vector")).alias("severity"), X.severity_confidence(X.cvss_severity(F.col("vector"))).alias("confidence"))


@query("""WITH dep AS (SELECT 'npm' AS ecosystem, p_name AS name, CAST(p_size AS VARCHAR) AS version, min(p_brand) AS manifest FROM part GROUP BY 2, 3), aff AS (SELECT DISTINCT p_name AS name, CAST(p_size AS VARCHAR) AS version, 'V-' || p_size AS vuln_id FROM part WHERE p_size % 5 = 0)
 SELECT vuln_id, ecosystem, name, version, manifest, 'high' AS severity, 0.95::DOUBLE AS confidence FROM dep JOIN aff USING (name, version)""")
def vuln_join(spark, d):
    p = P.table(spark, d, "part").select(F.lit("npm").alias("ecosystem"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), F.col("p_brand").alias("manifest"), "p_size")
    a = p.where("p_size % 5 = 0").select("ecosystem", "name", "version", F.concat(F.lit("V-"), "version").alias("vuln_id")).distinct()
    return C.vulnerable(p.drop("p_size"), a, a.select("vuln_id", F.lit("").alias("summary"), F.lit("CVSS:3.1/C:H").alias("vector")).distinct())


@query("""WITH dep AS (SELECT DISTINCT p_brand AS name, CAST(p_size AS VARCHAR) AS version FROM part), reg AS (SELECT DISTINCT p_brand AS name, substr(p_brand, 7, 1) = '1' AS archived, substr(p_brand, 8, 1) = '2' AS deprecated FROM part)
 SELECT 'npm' AS ecosystem, name, version, 'archived-dependency' AS kind, 0.9::DOUBLE AS confidence FROM dep JOIN reg USING (name) WHERE archived UNION ALL SELECT 'npm', name, version, 'deprecated-dependency', 0.8 FROM dep JOIN reg USING (name) WHERE deprecated UNION ALL SELECT 'npm', name, version, 'yanked-dependency', 0.9 FROM dep WHERE version = '7'""")
def dependency_health(spark, d):
    p = P.table(spark, d, "part")
    dep = p.select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version")).distinct()
    reg = dep.select("ecosystem", "name").distinct().select("ecosystem", "name", (F.substring("name", 7, 1) == "1").alias("archived"), (F.substring("name", 8, 1) == "2").alias("deprecated"), F.array(F.lit("7")).alias("yanked"), F.lit("2024-01-01").cast("timestamp").alias("pushed"))
    return C.dependency_health(dep, reg, NOW)


@query("""WITH r AS (SELECT o_orderkey AS number, bool_or(l_returnflag = 'R') AS ch, bool_or(l_returnflag = 'A') AS ap FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber <= 2 GROUP BY 1), x AS (SELECT o.o_orderkey AS number, coalesce(ch, false) AS ch, coalesce(ap, false) AS ap, (epoch(TIMESTAMP '2001-08-02') - epoch(o_orderdate)) / 86400.0 AS days FROM orders o JOIN r ON o.o_orderkey = r.number)
 SELECT number, CASE WHEN ch THEN 'github-pr-changes' WHEN ap THEN 'github-pr-approved' ELSE 'github-pr-pending' END AS kind, round(CASE WHEN ch THEN 0.7 + CASE WHEN days > 30 THEN 0.1 ELSE 0 END WHEN ap THEN 0.6 + CASE WHEN days > 14 THEN 0.1 ELSE 0 END ELSE 0.5 + CASE WHEN days > 14 THEN 0.05 ELSE 0 END END::DOUBLE, 6) AS confidence FROM x""")
def pull_requests(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_orderdate").cast("timestamp").alias("created"))
    r = P.table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("number"), F.when(F.col("l_returnflag") == "R", "CHANGES_REQUESTED").when(F.col("l_returnflag") == "A", "APPROVED").otherwise("COMMENTED").alias("state"))
    return C.pull_requests(o, r, ORDERS)


@query(f"""WITH {MARK} SELECT 'str-' || {ID} AS id, title, kind, CAST({PRIO} AS INTEGER) AS priority, file_path || ':' || line AS location FROM markers""")
def beads_jsonl(spark, d):
    row = F.from_json("value", "id string, title string, labels array<string>, priority int, description string")
    x = K.backlog_lines(S.with_id(marker_signals(spark, d))).select(row.alias("r")).select("r.*")
    return x.select("id", "title", F.get("labels", F.lit(0)).alias("kind"), "priority", F.regexp_extract("description", r"Location: (.*)$", 1).alias("location"))


@query(f"WITH {MARK} SELECT kind, CAST(dense_rank() OVER (ORDER BY kind) - 1 AS INTEGER) AS rule_index, count(*) AS results, CASE min({PRIO}) WHEN 1 THEN 'error' WHEN 2 THEN 'warning' WHEN 3 THEN 'note' ELSE 'none' END AS level FROM markers GROUP BY kind")
def sarif_rules(spark, d):
    return K.sarif_rules(marker_signals(spark, d))


@query(f"WITH {SNAP} SELECT signal_id, CASE WHEN signal_id NOT IN (SELECT signal_id FROM b) THEN 'new' WHEN signal_id NOT IN (SELECT signal_id FROM n) THEN 'absent' ELSE 'unchanged' END AS state FROM (SELECT signal_id FROM n UNION SELECT signal_id FROM b)")
def sarif_compare(spark, d):
    return D.fingerprints(*_snapshots(spark, d))


@query(r"""WITH b AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM benchmark), d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
 bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS s FROM b, range(1, 100000) t(i) WHERE i <= len(w) - 7), ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d))
 SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY 1, 2""")
def benchmark_overlap(spark, d):
    def words(t, key, pattern):
        return P.table(spark, d, t).select(key, F.filter(F.split(F.lower("text"), pattern), lambda x: x != "").alias("w"))

    def shingles(w, key, text):
        n = F.size("w") - 7
        at = F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
        one = lambda i: F.array_join(F.slice("w", i, 8), " ")
        return w.select(key, F.explode(F.transform(at, lambda i: F.struct(F.xxhash64(one(i)).alias("h"), one(i).alias("s")) if text else F.struct(F.xxhash64(one(i)).alias("h")))).alias("x")).select(key, "x.*")

    # hashes decide which documents' shingles are made out as text; only those are compared and counted
    from .plans.tables import written

    b = written(shingles(words("benchmark", "item_id", " "), "item_id", True).distinct())
    w = words("documents", "doc_id", r"\s+")
    hit = shingles(w, "doc_id", False).join(b.select("h").distinct(), "h", "left_semi").select("doc_id").distinct()
    own = shingles(w.join(hit, "doc_id", "left_semi"), "doc_id", True).join(b.select("h").distinct(), "h", "left_semi").distinct()
    return own.join(b, ["h", "s"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


QUERIES = {name: f for name, f, _ in _ALL}
ORACLE_SQL = {name: sql for name, _, sql in _ALL if sql}
FLAGSHIP = "module_summary"
