"""Queries of the engine's operators over the driver's tables, each beside its DuckDB SQL.

The tables stand in for the engine's own: documents for files and functions, labels for answers, pages for templates, events for attempts and usage,
lineitem for calls, orders and customer for candidates and tasks, conversations for roles, benchmark for benchmark cases.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import answers as A
from .functions import paths as P
from .functions import text as T
from .operators import configuration, elements, markup, relations, scoring, search_index
from .plans import context, coverage, event_log, lifecycle, planner, results
from .session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- counts and coverage

@query("SELECT o_orderstatus AS state, count(*) AS count FROM orders GROUP BY 1")
def state_counts(spark, sf):
    return coverage.counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("state")), "state")


@query("SELECT c_mktsegment AS theme, o_orderstatus AS decision, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def theme_decision_counts(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return coverage.counts(joined.select(F.col("c_mktsegment").alias("theme"), F.col("o_orderstatus").alias("decision")), "theme", "decision")


@query("SELECT lang AS language, count(*) AS count FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def language_without_labels(spark, sf):
    rest = relations.unmatched(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "doc_id")
    return coverage.counts(rest.select(F.col("lang").alias("language")), "language")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality <> 1")
def unlabelled_or_poor(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(l, "doc_id", "left").where("quality is null or quality != 1")


@query("""SELECT count(*) AS distinct_operations, coalesce(sum(records), 0)::BIGINT AS supporting_records, coalesce(sum((records > 1)::BIGINT), 0)::BIGINT AS repeated_groups
FROM (SELECT l_partkey * 10000 + l_suppkey AS k, count(*) AS records FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)""")
def operation_groups(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag != 'N'").select((F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("k"))
    return coverage.operation_groups(done, "k")


@query("""SELECT count(*) AS observed_requests, sum(nullif(k, 0))::BIGINT AS reported_input, sum(nullif(k, 1))::BIGINT AS reported_output,
sum((nullif(k, 0) IS NULL OR nullif(k, 1) IS NULL)::BIGINT)::BIGINT AS incomplete_events FROM (SELECT (props->>'$.k')::BIGINT AS k FROM events)""")
def usage_totals_nulls(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return coverage.usage_totals(table(spark, sf, "events").select(F.nullif(k, F.lit(0)).alias("i"), F.nullif(k, F.lit(1)).alias("o")), "i", "o")


@query("""WITH n AS (SELECT user_id AS id, event_type AS role, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT DISTINCT user_id AS id, 'error' AS role FROM events)
SELECT t.id, t.role, coalesce(n.n, 0) < 3 AS may_retry FROM t LEFT JOIN n ON t.id = n.id AND t.role = n.role""")
def attempts_under_three(spark, sf):
    events = table(spark, sf, "events")
    tasks = events.select(F.col("user_id").alias("id"), F.lit("error").alias("role")).distinct()
    return lifecycle.attempts_below(tasks, events.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("role")), F.col("role")).withColumnRenamed("_left", "may_retry")


# ---- answers, validation, ranking

def label_answers(spark, sf) -> DataFrame:
    """labels as two answers a document, with probabilities of their own."""
    wide = table(spark, sf, "labels").select("doc_id", F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (question, flag)"))
    bad = F.when(F.col("question") == "quality", 1 - F.col("flag")).otherwise(F.col("flag"))
    choice = F.when(bad == 0, "not_applicable").when(F.col("question") == "toxic", "local_defect").otherwise("context_required")
    base = wide.withColumn("choice", choice)
    p = lambda label, hit: F.when(F.col("choice") == label, hit).otherwise((1 - hit) / 3)
    sure = F.lit(0.7) + (F.col("doc_id") % 3) / 10
    return base.select("doc_id", "question", "choice", p("not_applicable", sure).alias("p_na"), p("local_defect", sure).alias("p_defect"), p("context_required", sure).alias("p_context"), p("locally_protected", sure).alias("p_protected"))


LABELS_SQL = """WITH f AS (SELECT doc_id, 'quality' AS question, 1 - quality AS bad FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels),
a AS (SELECT doc_id, question, CASE WHEN bad = 0 THEN 'not_applicable' WHEN question = 'toxic' THEN 'local_defect' ELSE 'context_required' END AS choice,
  0.7::DOUBLE + (doc_id % 3)::DOUBLE / 10::DOUBLE AS sure FROM f),
answers AS (SELECT doc_id, question, choice, CASE WHEN choice = 'not_applicable' THEN sure ELSE (1 - sure) / 3 END AS p_na, CASE WHEN choice = 'local_defect' THEN sure ELSE (1 - sure) / 3 END AS p_defect,
  CASE WHEN choice = 'context_required' THEN sure ELSE (1 - sure) / 3 END AS p_context, CASE WHEN choice = 'locally_protected' THEN sure ELSE (1 - sure) / 3 END AS p_protected FROM a)"""


@query(LABELS_SQL + " SELECT doc_id, question, choice, p_na, p_defect, p_context, p_protected FROM answers")
def answers_long(spark, sf):
    wide = label_answers(spark, sf).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("question", F.struct("choice", "p_na", "p_defect", "p_context", "p_protected")))).alias("answers"))
    return scoring.answers_long(wide, "doc_id")


@query(LABELS_SQL + """ SELECT doc_id, question, concat_ws(',', CASE WHEN p_off > 1 THEN 'probability' END, CASE WHEN abs(p_na + p_defect + p_context + p_off - 1) > 4 * 0.005 + 2.220446049250313e-16 THEN 'total' END,
 CASE WHEN sure_p + 0.000001 < greatest(p_na, p_defect, p_context, p_off) THEN 'maximum' END) AS violations
FROM (SELECT *, p_protected + CASE WHEN doc_id % 5 = 0 THEN 0.03 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 0.9 ELSE 0 END AS p_off,
 CASE choice WHEN 'not_applicable' THEN p_na WHEN 'local_defect' THEN p_defect ELSE p_context END AS sure_p FROM answers)""")
def validate_probabilities(spark, sf):
    off = F.col("p_protected") + F.when(F.col("doc_id") % 5 == 0, 0.03).otherwise(0.0) + F.when(F.col("doc_id") % 7 == 0, 0.9).otherwise(0.0)
    rows = label_answers(spark, sf).withColumn("p_protected", off)
    p = F.create_map(F.lit("not_applicable"), "p_na", F.lit("locally_protected"), "p_protected", F.lit("local_defect"), "p_defect", F.lit("context_required"), "p_context")
    found = A.violations(F.col("choice"), F.lit(0.5), p, F.array(*[F.lit(x) for x in A.DEFECT_LABELS]))
    return rows.select("doc_id", "question", F.concat_ws(",", found).alias("violations"))


@query(LABELS_SQL + """, s AS (SELECT doc_id, max(1 - p_na) AS relevance, max(p_defect) AS defect_evidence, max(p_context) AS context_needed,
  min(CASE choice WHEN 'local_defect' THEN 1 WHEN 'context_required' THEN 2 WHEN 'locally_protected' THEN 3 ELSE 4 END) AS place,
  coalesce(string_agg(CASE WHEN choice <> 'not_applicable' THEN question END, ',' ORDER BY question), '') AS relevant_categories FROM answers GROUP BY 1)
SELECT doc_id, relevance, defect_evidence, context_needed, (['local_defect', 'context_required', 'locally_protected', 'not_applicable'])[place] AS review_label, relevant_categories,
 row_number() OVER (ORDER BY relevance DESC, doc_id) AS relevance_rank, row_number() OVER (ORDER BY place, defect_evidence DESC, context_needed DESC, relevance DESC, doc_id) AS review_rank FROM s""")
def rank_documents(spark, sf):
    return scoring.rank(scoring.summarize(label_answers(spark, sf), "doc_id"), "doc_id")


@query("""WITH a AS (SELECT doc_id, 'quality' AS question, CASE quality WHEN 1 THEN 'present' ELSE 'absent' END AS choice FROM labels
 UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 'present' WHEN doc_id % 4 = 0 THEN 'unclear' ELSE 'absent' END FROM labels
 UNION ALL SELECT doc_id, 'guard_failure_behavior', CASE WHEN toxic = 1 THEN 'unclear' ELSE 'not_applicable' END FROM labels WHERE doc_id % 2 = 0)
SELECT doc_id, coalesce(string_agg(CASE WHEN choice = 'present' THEN question END, ',' ORDER BY question), '') AS present_categories,
 coalesce(string_agg(CASE WHEN choice = 'unclear' THEN question END, ',' ORDER BY question), '') AS unclear_categories,
 max(CASE WHEN question = 'guard_failure_behavior' THEN choice END) AS guard_failure_behavior FROM a GROUP BY 1""")
def classify_documents(spark, sf):
    l = table(spark, sf, "labels")
    toxic = F.when(F.col("toxic") == 1, "present").when(F.col("doc_id") % 4 == 0, "unclear").otherwise("absent")
    guard = F.when(F.col("doc_id") % 2 == 0, F.when(F.col("toxic") == 1, "unclear").otherwise("not_applicable"))
    wide = l.select("doc_id", F.when(F.col("quality") == 1, "present").otherwise("absent").alias("q"), toxic.alias("t"), guard.alias("g"))
    long = wide.select("doc_id", F.expr("stack(3, 'quality', q, 'toxic', t, 'guard_failure_behavior', g) as (question, choice)")).where("choice is not null")
    return scoring.classify(long, "doc_id")


@query("SELECT doc_id, quality IN (0, 1) AND toxic IN (0, 1) AS same_keys FROM labels")
def key_set_equality(spark, sf):
    m = F.map_from_entries(F.array(F.struct(F.concat(F.lit("quality"), F.when(F.col("quality").isin(0, 1), "").otherwise("?")), F.lit(1)), F.struct(F.concat(F.lit("toxic"), F.when(F.col("toxic").isin(0, 1), "").otherwise("?")), F.lit(1))))
    return table(spark, sf, "labels").select("doc_id", A.same_keys(m, F.array(F.lit("toxic"), F.lit("quality"))).alias("same_keys"))


@query("""SELECT choice, question, count(*) AS count FROM (SELECT 'quality' AS question, quality AS choice FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY ALL""")
def question_label_counts(spark, sf):
    return coverage.counts(table(spark, sf, "labels").select(F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (question, choice)")), "question", "choice")


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'reuse' WHEN l.quality = 0 THEN 'retry' ELSE 'queue' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""")
def reuse_or_retry(spark, sf):
    records = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "evaluated").otherwise("failed").alias("status"))
    return scoring.split_reusable(table(spark, sf, "documents").select("doc_id"), records, "doc_id")


# ---- planning

RULES = (("big-order", ("big",), ()), ("urgent-open", ("open",), ("urgent",)), ("finished", ("done",), ()), ("urgent-big", ("urgent", "rich"), ("big", "open")))


def order_subjects(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    purpose = F.when(F.col("c_mktsegment") == "MACHINERY", "test_or_fixture").when(F.col("c_mktsegment") == "BUILDING", "initialization").otherwise(P.PURPOSE_DEFAULT)
    subjects = rows.select(F.col("o_orderkey").alias("subject_id"), F.col("o_custkey").alias("file"), F.lit("function").alias("kind"), purpose.alias("purpose"))
    yes = lambda name, c: F.when(c, F.lit(name))
    found = F.array_compact(F.array(yes("big", F.col("o_totalprice") > 150000), yes("open", F.col("o_orderstatus") == "O"), yes("done", F.col("o_orderstatus") == "F"), yes("urgent", F.col("o_orderpriority").startswith("1")), yes("rich", F.col("c_acctbal") > 5000), yes("input_external_request_event_or_user", F.col("o_orderkey") % 3 == 0), yes("influence_interpreted_structure", F.col("o_orderkey") % 5 == 0), yes("influence_target_selection", F.col("o_orderkey") % 7 == 0)))
    answers = rows.select(F.col("o_orderkey").alias("subject_id"), F.explode(found).alias("question"), F.lit("present").alias("choice"))
    return subjects, answers, c.where("c_acctbal < 0").select(F.col("c_custkey").alias("file"))


PLAN_SQL = """WITH s AS (SELECT o_orderkey AS subject_id, o_custkey AS file, CASE c_mktsegment WHEN 'MACHINERY' THEN 'test_or_fixture' WHEN 'BUILDING' THEN 'initialization' ELSE 'application_candidate' END AS purpose,
  o_totalprice > 150000 AS big, o_orderstatus = 'O' AS open_, o_orderstatus = 'F' AS done, o_orderpriority LIKE '1%' AS urgent, c_acctbal > 5000 AS rich, c_acctbal < 0 AS routed,
  greatest(0, 100 - CASE WHEN o_orderkey % 3 = 0 THEN 35 ELSE 0 END - CASE WHEN o_orderkey % 5 = 0 THEN 20 ELSE 0 END - CASE WHEN o_orderkey % 7 = 0 THEN 10 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 25 ELSE 0 END) AS p0
  FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT *, list_filter([CASE WHEN big THEN 'big-order' END, CASE WHEN open_ AND urgent THEN 'urgent-open' END, CASE WHEN done THEN 'finished' END, CASE WHEN (urgent OR rich) AND (big OR open_) THEN 'urgent-big' END], lambda x: x IS NOT NULL) AS ts FROM s),
u AS (SELECT *, unnest(CASE WHEN len(ts) > 0 THEN ts ELSE ['general-review'] END) AS theme FROM t),
c AS (SELECT sha256(length(subject_id::VARCHAR) || ':' || subject_id || length(theme) || ':' || theme) AS id, subject_id, file, theme, purpose, CASE WHEN routed THEN greatest(0, p0 - 20) ELSE p0 END AS p1,
  sha256('plan-1' || subject_id || theme) AS rank, CASE WHEN purpose = 'test_or_fixture' THEN 'excluded' ELSE 'deferred' END AS decision FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY decision, file ORDER BY p1, rank, id) AS fr, row_number() OVER (PARTITION BY decision, theme ORDER BY p1, rank, id) AS tr FROM c),
p AS (SELECT id, subject_id, file, theme, purpose, rank, decision, (CASE WHEN decision = 'deferred' THEN p1 + (fr - 1) * 20 + (tr - 1) * 4 ELSE p1 END)::BIGINT AS priority FROM r)"""
PLAN_COLUMNS = ["id", "subject_id", "file", "theme", "purpose", "rank", "decision", "priority"]


@query(PLAN_SQL + " SELECT subject_id, theme FROM p")
def rule_matches(spark, sf):
    subjects, answers, _ = order_subjects(spark, sf)
    return planner.candidates(subjects, answers, "plan-1", RULES).select("subject_id", "theme")


@query(PLAN_SQL + " SELECT id, subject_id, file, theme, purpose, rank, CASE decision WHEN 'deferred' THEN 'selected' ELSE decision END AS decision, priority FROM p")
def plan_full(spark, sf):
    return planner.plan(*order_subjects(spark, sf), rules=RULES).select(*PLAN_COLUMNS)


@query(PLAN_SQL + """, f AS (SELECT id, subject_id FROM p WHERE decision = 'deferred' ORDER BY priority, rank, id LIMIT 80),
k AS (SELECT subject_id, min(rank) AS rank, any_value(purpose) AS purpose, any_value(file) AS file FROM p WHERE decision = 'deferred' AND subject_id NOT IN (SELECT subject_id FROM f) GROUP BY 1 ORDER BY 2, 1 LIMIT 20),
m AS (SELECT id FROM p WHERE decision = 'deferred' AND id NOT IN (SELECT id FROM f) ORDER BY priority, rank, id LIMIT (SELECT 20 - count(*) FROM k))
SELECT id, subject_id, file, theme, purpose, rank, CASE WHEN id IN (SELECT id FROM f UNION ALL SELECT id FROM m) THEN 'selected' ELSE decision END AS decision, priority FROM p
UNION ALL SELECT sha256(length(subject_id::VARCHAR) || ':' || subject_id || '14:control-sample'), subject_id, file, 'control-sample', purpose, rank, 'selected', 150 FROM k""")
def plan_sample_controls(spark, sf):
    return planner.plan(*order_subjects(spark, sf), maximum=100, rules=RULES).select(*PLAN_COLUMNS)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def theme_top_k(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return relations.first_rows(rows, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 25)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def best_per_supplier(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return relations.best_per(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)


# ---- the queue

def order_tasks(spark, sf) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    role = F.element_at(F.array(*[F.lit(r) for r in lifecycle.ROLES]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    running = state == "running"
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), state.alias("state"), role.alias("role"), F.when(running, F.concat(F.lit("a"), "o_orderkey")).alias("attempt"),
        F.when(running, F.col("o_orderkey") * 10).alias("deadline"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"),
    )


TASK_SQL = """WITH t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'running' END AS state,
  (['localizer', 'investigator', 'challenger'])[1 + o_orderkey % 3] AS role, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'a' || o_orderkey END AS attempt,
  CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN o_orderkey * 10 END AS deadline, o_orderpriority[1]::INT AS priority FROM orders)"""


@query(TASK_SQL + ", f AS (SELECT id FROM t WHERE state = 'queued' ORDER BY priority, id LIMIT 7) SELECT id, role, sha256(id || ':' || role || ':1000') AS attempt, 121000 AS deadline, priority FROM t WHERE id IN (SELECT id FROM f)")
def claim_next(spark, sf):
    claimed = lifecycle.claim(order_tasks(spark, sf), 9, now=1000, timeout_ms=120_000, calls=5, most_calls=12)
    return claimed.where("state = 'running' and deadline = 121000 and length(attempt) = 64").select("id", "role", "attempt", F.col("deadline").cast("int").alias("deadline"), "priority")


@query(TASK_SQL + """ SELECT id, CASE WHEN late THEN 'queued' ELSE state END AS state, CASE WHEN late THEN NULL ELSE attempt END AS attempt, CASE WHEN late THEN NULL ELSE deadline END AS deadline,
 CASE WHEN late THEN 'expired_attempt' END AS error FROM (SELECT *, coalesce(state = 'running' AND deadline < 50000, false) AS late FROM t)""")
def recover_expired(spark, sf):
    return lifecycle.recover(order_tasks(spark, sf), 50_000).select("id", "state", "attempt", "deadline", "error")


FINISH_SQL = TASK_SQL + """, r AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'old' ELSE attempt END AS a, CASE WHEN id % 5 = 0 THEN 'refuted_hypothesis' ELSE 'supported_candidate' END AS disposition FROM t WHERE state = 'running'),
x AS (SELECT t.*, r.id IS NOT NULL AS hit, t.role = 'challenger' OR disposition = 'refuted_hypothesis' AS ends FROM t LEFT JOIN r ON t.id = r.id AND t.attempt = r.a)"""


@query(FINISH_SQL + """ SELECT id, CASE WHEN hit THEN CASE WHEN ends THEN 'completed' ELSE 'queued' END ELSE state END AS state,
 CASE WHEN hit AND NOT ends THEN CASE role WHEN 'localizer' THEN 'investigator' ELSE 'challenger' END ELSE role END AS role, CASE WHEN hit THEN 'r' || id END AS result FROM x""")
def finish_tasks(spark, sf):
    tasks = order_tasks(spark, sf)
    results = tasks.where("state = 'running'").select("id", F.when(F.col("id") % 4 == 0, "old").otherwise(F.col("attempt")).alias("attempt"), F.when(F.col("id") % 5 == 0, "refuted_hypothesis").otherwise("supported_candidate").alias("disposition"), F.concat(F.lit("r"), "id").alias("result"))
    return lifecycle.finish(tasks, results).select("id", "state", "role", "result")


@query(TASK_SQL + " SELECT id, 'old' AS attempt FROM t WHERE state = 'running' AND id % 4 = 0")
def stale_results(spark, sf):
    tasks = order_tasks(spark, sf)
    return lifecycle.stale(tasks, tasks.where("state = 'running'").select("id", F.when(F.col("id") % 4 == 0, "old").otherwise(F.col("attempt")).alias("attempt")))


@query("""WITH t AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT role, next, count(*) AS count FROM t GROUP BY 1, 2""")
def role_transitions(spark, sf):
    return lifecycle.transitions(table(spark, sf, "conversations"), "conv_id", ["turn"], "role")


@query("""WITH m AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
SELECT user_id, run::BIGINT AS run, count(*) AS length FROM m WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2""")
def failure_breaker(spark, sf):
    found = lifecycle.failure_breaks(table(spark, sf, "events"), ["ts", "event_id"], "user_id", F.col("event_type") == "error", 2)
    return found.select("user_id", "run", "length")


#: Each task's events one after the other, by recursion over their number.
LOG_SQL = """WITH RECURSIVE e AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id AS pos, 'a' || event_id % 2 AS name,
 CASE event_type WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'expired' ELSE 'retried' END AS kind,
 CASE event_id % 3 WHEN 0 THEN 'refuted_hypothesis' ELSE 'supported_candidate' END AS disposition FROM events),
s AS (SELECT DISTINCT id, 0::BIGINT AS k, 'queued' AS state, 'localizer' AS role, NULL::VARCHAR AS attempt, NULL::BIGINT AS deadline, 0 AS l, 0 AS i, 0 AS c, 0 AS accepted FROM e
 UNION ALL SELECT id, k, CASE WHEN claims THEN 'running' WHEN ends THEN 'completed' WHEN gives THEN 'queued' WHEN fails THEN 'failed' WHEN late OR again THEN 'queued' ELSE state END,
  CASE WHEN gives AND NOT ends THEN CASE role WHEN 'localizer' THEN 'investigator' ELSE 'challenger' END ELSE role END,
  CASE WHEN claims THEN name WHEN late OR again THEN NULL ELSE attempt END, CASE WHEN claims THEN pos + 400 WHEN gives OR fails OR late THEN NULL ELSE deadline END,
  l + (claims AND role = 'localizer')::INT, i + (claims AND role = 'investigator')::INT, c + (claims AND role = 'challenger')::INT, accepted + (claims OR gives OR fails OR late OR again)::INT FROM (
  SELECT *, own AND kind = 'result' AS gives, own AND kind = 'result' AND (role = 'challenger' OR disposition = 'refuted_hypothesis') AS ends, own AND kind = 'failed' AS fails, own AND kind = 'expired' AND deadline < pos AS late,
   kind = 'claimed' AND state = 'queued' AS claims, kind = 'retried' AND state = 'failed' AND CASE role WHEN 'localizer' THEN l WHEN 'investigator' THEN i ELSE c END < 3 AS again
  FROM (SELECT s.id, e.k, e.pos, e.name, e.kind, e.disposition, state, role, attempt, deadline, l, i, c, accepted, coalesce(state = 'running' AND attempt = e.name, false) AS own FROM s JOIN e ON s.id = e.id AND e.k = s.k + 1)))
SELECT id, state, role, attempt, deadline, l + i + c AS attempts, accepted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS last FROM s) WHERE last = 1"""


@query(LOG_SQL)
def event_log_fold(spark, sf):
    e = table(spark, sf, "events")
    kinds = F.create_map(*[F.lit(x) for x in ("click", "claimed", "purchase", "result", "error", "failed", "view", "expired")])
    log = e.select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("sequence"), F.coalesce(kinds[F.col("event_type")], F.lit("retried")).alias("kind"), F.concat(F.lit("a"), (F.col("event_id") % 2).cast("string")).alias("attempt"),
        F.col("event_id").alias("at"), (F.col("event_id") + 400).alias("deadline"), F.when(F.col("event_id") % 3 == 0, "refuted_hypothesis").otherwise("supported_candidate").alias("disposition"), F.lit("r").alias("result"), F.lit("e").alias("error"),
    )
    done = event_log.fold(e.select(F.col("user_id").alias("id")).distinct(), log)
    accepted = F.size(F.filter("outcomes", lambda o: o["accepted"]))
    return done.select("id", "state", "role", "attempt", "deadline", F.size("attempts").alias("attempts"), accepted.alias("accepted"))


@query("""WITH d AS (SELECT o_orderstatus, CASE l_returnflag WHEN 'R' THEN 'needs_context' WHEN 'A' THEN 'budget_exhausted' ELSE 'supported_candidate' END AS disposition FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS outstanding, count(*) AS unresolved_completed FROM d WHERE disposition <> 'supported_candidate'""")
def uncertain_results(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued").alias("state"))
    said = F.when(F.col("l_returnflag") == "R", "needs_context").when(F.col("l_returnflag") == "A", "budget_exhausted").otherwise("supported_candidate")
    results = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), said.alias("disposition"), F.lit("k").alias("operation_key"))
    return coverage.coverage_summary({"tasks": tasks, "task_results": results})["execution"].select("outstanding", "unresolved_completed")


@query("""WITH n AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), t AS (SELECT DISTINCT user_id AS id FROM events)
SELECT t.id, CASE WHEN coalesce(n, 0) < 3 THEN 'queued' ELSE 'failed' END AS state FROM t LEFT JOIN n USING (id)""")
def retry_failed(spark, sf):
    events = table(spark, sf, "events")
    tasks = events.select(F.col("user_id").alias("id"), F.lit("failed").alias("state"), F.lit("error").alias("role"), F.lit("a").alias("attempt"), F.lit("e").alias("error")).distinct()
    return lifecycle.retry_failed(tasks, events.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("role"))).select("id", "state")


# ---- pages, spans, search

@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, true AS has_more FROM lineitem WHERE l_suppkey = 7 AND l_orderkey * 10 + l_linenumber > 1000 ORDER BY 1 LIMIT 16")
def keyset_page(spark, sf):
    calls = table(spark, sf, "lineitem").where("l_suppkey = 7").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey")
    return relations.keyset_page(calls, "id", 1000, 20, F.lit(6000))  # 16 rows of these fit the budget


#: All files and calls are numbered; the page's are told by their numbers.
@query("""WITH f AS (SELECT o_orderkey AS file, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey >= 7),
c AS (SELECT l_orderkey AS file, l_linenumber AS ordinal, l_returnflag = 'R' AS hit FROM lineitem JOIN f ON l_orderkey = file WHERE n <= 10 AND (l_orderkey > 7 OR l_linenumber > 1)),
w AS (SELECT *, row_number() OVER (ORDER BY file, ordinal) <= 500 AND coalesce(sum(hit::INT) OVER (ORDER BY file, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 6 AS inside FROM c),
s AS (SELECT count(*) FILTER (WHERE inside) AS examined, count(*) FILTER (WHERE NOT inside) > 0 AS capped, max((file, ordinal)) FILTER (WHERE inside) AS last FROM w)
SELECT file, ordinal, hit, (CASE WHEN capped THEN last[1] ELSE (SELECT max(file) FROM f WHERE n <= 10) END)::BIGINT AS next_file, (CASE WHEN capped THEN last[2] ELSE 2147483647 END)::INTEGER AS next_ordinal,
 NOT capped AND (SELECT count(*) FROM f) <= 10 AS exhausted, examined FROM s LEFT JOIN (SELECT * FROM w WHERE inside) ON true""")
def work_capped_page(spark, sf):
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"))
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("ordinal"), "l_returnflag")
    return relations.capped_page(files, calls, F.col("l_returnflag") == "R", (7, 1), 6).drop("l_returnflag")


LINES_SQL = """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
l AS (SELECT doc_id, line, t, (sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(t) - 1)::BIGINT AS s FROM p), lines AS (SELECT doc_id, line, t, s AS "start", s + length(t) AS "end" FROM l)"""


def document_lines(spark, sf) -> DataFrame:
    return relations.text_lines(table(spark, sf, "documents"), ["doc_id"], F.col("text"))


@query(LINES_SQL + ' SELECT doc_id, line, "start", "end" FROM lines')
def line_offsets(spark, sf):
    return document_lines(spark, sf)


@query("""SELECT o.l_orderkey, o.l_linenumber, i.l_linenumber AS inner_line FROM (SELECT *, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity AS e FROM lineitem) o
JOIN (SELECT *, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity AS e FROM lineitem) i ON o.l_orderkey = i.l_orderkey AND o.s <= i.s AND o.e >= i.e AND o.l_linenumber <> i.l_linenumber""")
def span_containment(spark, sf):
    spans = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("end"))
    return relations.span_join(spans, spans, "l_orderkey", "contains", bucket=32).where("l_linenumber != r_l_linenumber").select("l_orderkey", "l_linenumber", F.col("r_l_linenumber").alias("inner_line"))


SEARCH_SQL = """hits AS (SELECT doc_id, needle, unnest(pos) AS "start" FROM (SELECT doc_id, needle, list_transform(range(1, len(parts)), lambda k: (list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(needle))::BIGINT) AS pos
 FROM (SELECT doc_id, needle, string_split(text, needle) AS parts FROM documents CROSS JOIN (VALUES ('the and'), (' of the ')) v(needle)) WHERE len(parts) > 1))"""
NEEDLES = ("the and", " of the ")


def needle_hits(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(*[F.lit(n) for n in NEEDLES])).alias("needle"))
    return relations.hits(docs, ["doc_id", "needle"], F.col("text"), F.col("needle"))


@query("WITH " + SEARCH_SQL + ' SELECT doc_id, needle, "start", "start" + length(needle) AS "end" FROM hits')
def literal_search(spark, sf):
    return needle_hits(spark, sf)


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 8000)) AS s FROM documents) SELECT doc_id, s AS "start", length(substr(text, s + 1, 8200)) AS n_chars FROM c""")
def text_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.start").cast("long").alias("start"), F.length("c.text").cast("long").alias("n_chars"))


@query(LINES_SQL + ", " + SEARCH_SQL + ' SELECT l.doc_id, l.line, h.needle, h."start" AS hit FROM lines l JOIN hits h ON l.doc_id = h.doc_id AND l."start" <= h."start" + length(needle) AND l."end" > h."start"')
def benchmark_overlap(spark, sf):
    return relations.span_join(document_lines(spark, sf), needle_hits(spark, sf), "doc_id", "overlaps", bucket=4096).select("doc_id", "line", F.col("r_needle").alias("needle"), F.col("r_start").alias("hit"))


@query(LINES_SQL + ", " + SEARCH_SQL + """ SELECT h.doc_id, needle, h."start" FROM hits h JOIN documents d ON d.doc_id = h.doc_id WHERE EXISTS (SELECT 1 FROM lines l JOIN labels b ON b.doc_id = l.doc_id
 WHERE l.doc_id = h.doc_id AND l."start" <= h."start" AND l."end" >= h."start" + length(needle) AND sha256(d.text) = CASE WHEN b.quality = 0 THEN 'changed' ELSE sha256(d.text) END)""")
def citation_observed(spark, sf):
    """Citations in lines that were served, those of labelled documents; poor ones have changed since, so their digest differs."""
    digests = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    served = document_lines(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").join(digests, "doc_id")
    served = served.withColumn("hash", F.when(F.col("quality") == 0, "changed").otherwise(F.col("hash")))
    cited = needle_hits(spark, sf).join(digests, "doc_id")
    return relations.observed(cited, served, ["doc_id", "hash"]).select("doc_id", "needle", "start")


@query(LINES_SQL + """ SELECT a.doc_id, a.line, b.line AS same FROM lines a LEFT JOIN (SELECT l.* FROM lines l JOIN labels USING (doc_id)) b ON a.doc_id = b.doc_id AND a."start" = b."start" AND a."end" = b."end" """)
def exact_span_match(spark, sf):
    lines = document_lines(spark, sf)
    labelled = lines.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    return relations.span_join(lines, labelled, "doc_id", "equal", kind="left").select("doc_id", "line", F.col("r_line").alias("same"))


# ---- content, reuse, upserts

@query("""SELECT d.doc_id, sha256(d.text) AS hash, coalesce(sha256(d.text) = sha256(p.text), false) AS reused FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0) p USING (doc_id)""")
def reuse_unchanged(spark, sf):
    d = table(spark, sf, "documents")
    now = d.select("doc_id", F.sha2("text", 256).alias("hash"))
    before = d.where("doc_id % 9 != 0").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "!").otherwise("")), 256).alias("hash"))
    return relations.reuse(now, before, "doc_id")


@query("""SELECT doc_id, problem FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'unexpected' WHEN a.h <> b.h THEN 'changed' END AS problem
FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 8 = 0 THEN upper(text) || '.' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 2) b ON a.doc_id = b.doc_id) WHERE problem IS NOT NULL""")
def inventory_drift(spark, sf):
    d = table(spark, sf, "documents")
    a = d.where("doc_id % 10 != 3").select("doc_id", F.sha2("text", 256).alias("hash"))
    b = d.where("doc_id % 11 != 2").select("doc_id", F.sha2(F.when(F.col("doc_id") % 8 == 0, F.concat(F.upper("text"), F.lit("."))).otherwise(F.col("text")), 256).alias("hash"))
    return relations.drift(a, b, "doc_id")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS x FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN sha256(upper(text) || '.') ELSE sha256(text) END AS y FROM documents WHERE doc_id % 11 <> 2)
SELECT doc_id, CASE WHEN y IS NULL THEN 'missing' WHEN x IS NULL THEN 'unexpected' ELSE 'changed' END AS problem FROM a FULL JOIN b USING (doc_id) WHERE x IS DISTINCT FROM y""")
def tree_difference(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    a = d.where("doc_id % 10 != 3").select("doc_id", F.sha2("text", 256).alias("hash"))
    b = d.where("doc_id % 11 != 2").select("doc_id", F.sha2(F.when(F.col("doc_id") % 8 == 0, F.concat(F.upper("text"), F.lit("."))).otherwise(F.col("text")), 256).alias("hash"))
    trees = [relations.digest_tree(cut(x), "doc_id", "hash") for x in (a, b)]
    return relations.tree_drift(*[(cut(nodes), leaves) for nodes, leaves in trees], "doc_id", "hash")


@query("SELECT sha256(text) AS digest, any_value(length(text)) AS n_chars FROM documents GROUP BY 1")
def artifact_dedupe(spark, sf):
    stored = relations.artifacts(table(spark, sf, "documents"), "text")
    return relations.intact(stored).select("digest", F.length("json").cast("long").alias("n_chars"))


#: The tree of digests, 64 at a time; a group that has one node left keeps it.
TREE_SQL = "WITH l0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, sha256(doc_id || chr(31) || sha256(text)) AS h FROM documents), l1 AS (SELECT source, k // 64 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l0 GROUP BY ALL)"
for _level in range(2, 6):
    TREE_SQL += f", l{_level} AS (SELECT source, k // 64 AS k, CASE WHEN max(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY x.k)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM l{_level - 1}) AS x GROUP BY source, x.k // 64)"


@query(f"{TREE_SQL} SELECT source, h AS fingerprint FROM l5")
def ordered_fingerprint(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("hash"))
    return relations.ordered_digest(rows, ["doc_id"], ["doc_id", "hash"], ["source"])


@query("""SELECT doc_id, sha256('1:2' || '64:' || sha256(text) || length(doc_id::VARCHAR) || ':' || doc_id || length(text) || ':' || text || '~' || '7:model-1') AS key FROM documents""")
def request_keys(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", A.request_key(F.sha2("text", 256), F.col("doc_id"), F.col("text"), F.lit(None).cast("string"), F.lit("model-1")).alias("key"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id >= 500 DESC, ts DESC, event_id DESC) AS pos FROM events) WHERE pos = 1""")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return relations.last_wins(e.where("event_id < 500"), e.where("event_id >= 500"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)""")
def insert_if_absent(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return relations.first_wins(o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")), o.where("o_orderkey % 2 = 1"), ["o_custkey"], ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'boosted' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_in_subquery(spark, sf):
    poor = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return relations.update_in(table(spark, sf, "orders"), poor, "o_custkey", "o_orderstatus", F.lit("boosted")).select("o_orderkey", "o_orderstatus")


# ---- paths and markup

@query(r"""SELECT page_id, CASE WHEN regexp_matches(p, '(?i)(^|/)(tests?|__tests__|fixtures|__fixtures__|mocks|__mocks__|codefixes|testdata)(/|$)|\.(test|spec|stories)\.') THEN 'test_or_fixture'
WHEN regexp_matches(p, '(?i)(^|/)(examples|docker-examples|tools|scripts)(/|$)|(^|/)(cypress|playwright|vitest|jest|eslint|webpack|vite)\.config\.') THEN 'example_or_tooling'
WHEN regexp_matches(p, '(?i)(^|/)(vendor|vendors|third_party|third-party)(/|$)|\.min\.[cm]?js$') THEN 'vendor' WHEN regexp_matches(p, '(?i)(^|/)(seeds?|migrations|startup|initialization)(/|$)') THEN 'initialization' ELSE 'application_candidate' END AS purpose,
CASE WHEN regexp_matches(p, '(?i)\.[cm]?[jt]sx?$') THEN 'tsjs' WHEN regexp_matches(p, '(?i)\.cs$') THEN 'csharp' WHEN regexp_matches(p, '(?i)\.(?:html?|ejs|hbs|handlebars|pug|cshtml|razor|vue|svelte)$') THEN 'template' WHEN regexp_matches(p, '(?i)\.md$') THEN 'documentation' ELSE 'configuration' END AS language
FROM (SELECT page_id, (['src/tests/a.spec.ts', 'tools/build.js', 'vendor/x.min.js', 'db/seeds/s.cs', 'docs/readme.md', ''])[1 + page_id % 6] || '/' || regexp_replace(url, '^[a-z]+://', '') AS p FROM pages
UNION ALL SELECT page_id, (['src/tests/a.spec.ts', 'tools/build.js', 'vendor/x.min.js', 'db/seeds/s.cs', 'docs/readme.md', 'page.vue'])[1 + page_id % 6] FROM pages)""")
def purpose_cascade(spark, sf):
    names = ["src/tests/a.spec.ts", "tools/build.js", "vendor/x.min.js", "db/seeds/s.cs", "docs/readme.md"]
    pick = lambda last: F.element_at(F.array(*[F.lit(n) for n in [*names, last]]), (F.col("page_id") % 6 + 1).cast("int"))
    p = table(spark, sf, "pages")
    rows = p.select("page_id", F.concat(pick(""), F.lit("/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("p")).unionByName(p.select("page_id", pick("page.vue").alias("p")))
    return rows.select("page_id", P.purpose(F.col("p")).alias("purpose"), P.language(F.col("p")).alias("language"))


@query(r"""WITH f AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM pages), w AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '(/|\.html)$', '') AS b FROM pages),
c AS (SELECT page_id, unnest([b, b || '.html', b || '/', b || '/index.html']) AS path, unnest([1, 2, 3, 4]) AS pos FROM w), h AS (SELECT page_id, arg_min(path, pos) AS resolved FROM c JOIN f USING (path) GROUP BY 1)
SELECT page_id, resolved FROM (SELECT DISTINCT page_id FROM w) LEFT JOIN h USING (page_id)""")
def path_resolution(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1).alias("path"))
    base = F.regexp_replace("path", r"(/|\.html)$", "")
    options = F.array(base, F.concat(base, F.lit(".html")), F.concat(base, F.lit("/")), F.concat(base, F.lit("/index.html")))
    return relations.first_existing(p.select("page_id", "path"), p.select("path"), "page_id", options)


@query(r"""SELECT page_id, sha256(m) AS masked_sha256, length(m) = length(html) AS same_length FROM (SELECT page_id, html, array_to_string(list_transform(regexp_extract_all(html, '(?s)<!--.*?-->|[^<]+|<'),
 lambda x: CASE WHEN starts_with(x, '<!--') AND length(x) > 4 THEN regexp_replace(x, '[^\r\n\x{2028}\x{2029}]', ' ', 'g') ELSE x END), '') AS m FROM pages)""")
def html_comment_mask(spark, sf):
    m = table(spark, sf, "pages").select("page_id", "html", markup.masked(F.col("html")).alias("m"))
    return m.select("page_id", F.sha2("m", 256).alias("masked_sha256"), (F.length("m") == F.length("html")).alias("same_length"))


MASKED_SQL = r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?s)<!--.*?-->|[^<]+|<'),
 lambda x: CASE WHEN starts_with(x, '<!--') AND length(x) > 4 THEN regexp_replace(x, '[^\r\n\x{2028}\x{2029}]', ' ', 'g') ELSE x END), '') AS m FROM pages"""


#: Tags by cutting pages at each <: comments and raw texts are told by what was opened last.
TAGS_SQL = r"""p AS (SELECT page_id, unnest(string_split(html, '<')) AS piece, generate_subscripts(string_split(html, '<'), 1) AS k FROM pages),
o AS (SELECT page_id, k, piece, lower(regexp_extract(piece, '^/?([a-zA-Z][^\s/>]*)', 1)) AS name, starts_with(piece, '/') AS closes, strpos(piece, '>') AS gt,
 (sum(length(piece) + 1) OVER (PARTITION BY page_id ORDER BY k) - length(piece) - 2)::BIGINT AS s,
 coalesce(max(CASE WHEN starts_with(piece, '!--') THEN k END) OVER before, 0) > coalesce(max(CASE WHEN contains(piece, '-->') THEN k END) OVER before, 0) AS hidden
 FROM p WINDOW before AS (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
raw AS (SELECT *, name IN ('script', 'style', 'textarea', 'title', 'xmp', 'iframe', 'noembed', 'noframes') AS is_raw FROM o WHERE k > 1 AND NOT hidden AND name <> '' AND gt > 0),
tags AS (SELECT page_id, k, name, closes, s, s + gt + 0 AS e, substr(piece, 1, gt) AS tag FROM (
 SELECT *, coalesce(max(CASE WHEN is_raw AND NOT closes THEN k END) OVER b, 0) > coalesce(max(CASE WHEN is_raw AND closes THEN k END) OVER b, 0) AS within
 FROM raw WINDOW b AS (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE NOT within OR (is_raw AND closes)),
opened AS (SELECT *, name IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr') AS void FROM tags WHERE NOT closes)"""


@query(rf"""WITH {TAGS_SQL} SELECT page_id, s AS "start", (e + 1)::BIGINT AS "end", name AS tag FROM opened""")
def html_anchors(spark, sf):
    return markup.anchors(table(spark, sf, "pages"), "page_id", "html")


#: An element's end tag is the first of its name with as many opened as closed ones between; else it ends with what is around it, or where its sibling begins.
@query(rf"""WITH {TAGS_SQL}, c AS (SELECT * FROM tags WHERE closes),
pairs AS (SELECT o.page_id, o.k, o.s, min(c.k) AS ck FROM opened o JOIN c ON o.page_id = c.page_id AND o.name = c.name AND c.k > o.k AND NOT o.void
 AND (SELECT count(*) FROM opened x WHERE x.page_id = o.page_id AND x.name = o.name AND x.k > o.k AND x.k < c.k)
   = (SELECT count(*) FROM c y WHERE y.page_id = o.page_id AND y.name = o.name AND y.k > o.k AND y.k < c.k) GROUP BY ALL),
placed AS (SELECT o.*, p.ck, (SELECT count(*) FROM pairs q WHERE q.page_id = o.page_id AND q.k < o.k AND q.ck > o.k) AS level,
 (SELECT min(q.ck) FROM pairs q WHERE q.page_id = o.page_id AND q.k < o.k AND q.ck > o.k) AS outer_k FROM opened o LEFT JOIN pairs p ON p.page_id = o.page_id AND p.k = o.k),
ends AS (SELECT x.*, t.e + 1 AS own_end, u.s AS outer_start, length(g.html) AS last,
 CASE WHEN x.name IN ('p', 'li', 'dt', 'dd', 'tr', 'td', 'th', 'option') THEN (SELECT min(z.s) FROM placed z WHERE z.page_id = x.page_id AND z.name = x.name AND z.k > x.k AND z.level = x.level) END AS sibling
 FROM placed x JOIN pages g ON g.page_id = x.page_id LEFT JOIN tags t ON t.page_id = x.page_id AND t.k = x.ck LEFT JOIN tags u ON u.page_id = x.page_id AND u.k = x.outer_k)
SELECT page_id, s AS "start", (CASE WHEN void THEN e + 1 WHEN ck IS NOT NULL THEN own_end ELSE least(coalesce(outer_start, last), coalesce(sibling, last)) END)::BIGINT AS "end", name FROM ends""")
def html_elements(spark, sf):
    anchors = elements.template_anchors(table(spark, sf, "pages"), "page_id", "html")
    return anchors.where("kind = 'template_node' and name not like '#%'").select("page_id", "start", "end", "name")


@query(rf"""WITH {TAGS_SQL}, a AS (SELECT page_id, s, tag, unnest(regexp_extract_all(tag, '\s[^\s=>]+="[^"]*"')) AS x FROM opened)
SELECT page_id, (s + strpos(tag, x) + 1)::BIGINT AS "start", (s + strpos(tag, x) + length(x))::BIGINT AS "end", lower(regexp_extract(x, '\s([^=]+)=', 1)) AS name, lower(regexp_extract(x, '\s([^=]+)=', 1)) IN ('[innerhtml]', 'v-html') AS html_binding FROM a""")
def html_attributes(spark, sf):
    anchors = elements.template_anchors(table(spark, sf, "pages"), "page_id", "html")
    return anchors.where("kind = 'template_attribute'").select("page_id", "start", "end", "name", "html_binding")


@query(r"""WITH m AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages), e AS (SELECT page_id, unnest(regexp_extract_all(h, '(?i)\shref="([^"]*)"', 1)) AS href FROM m)
SELECT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href ELSE array_to_string(list_filter(string_split(href, '/'), lambda x: x NOT IN ('', '.')), '/') END AS target FROM e""")
def html_links(spark, sf):
    p = table(spark, sf, "pages").withColumn("path", F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1))
    return markup.links(p, "page_id", "html", "path")


@query("SELECT event_id, 'k' AS name, props->>'$.k' AS value FROM events")
def json_facts(spark, sf):
    return markup.json_facts(table(spark, sf, "events"), "event_id", "props")


@query(r"""SELECT doc_id, translate(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&#38;'), '<', '&#60;'), '>', '&#62;'), '|', '&#124;'), '[', '&#91;'), ']', '&#93;'), '`', '&#96;'), '\', '&#92;'), chr(13) || chr(10), '  ') AS escaped FROM documents""")
def markdown_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.markdown_escape(F.col("text")).alias("escaped"))


@query("SELECT 'call' AS kind, l_orderkey AS id FROM lineitem WHERE l_quantity = 50 UNION ALL SELECT 'anchor', o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'")
def union_anchor_or_call(spark, sf):
    calls = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("id"))
    anchors = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("id"))
    return relations.merged(("call", calls), ("anchor", anchors))


# ---- recall and summaries

@query("""WITH c AS (SELECT d.doc_id, CASE WHEN d.doc_id % 6 = 0 THEN 'negative' ELSE 'positive' END AS expected, l.doc_id IS NOT NULL AS selected, coalesce(l.quality = 1, false) AS investigated, coalesce(l.quality = 1 AND l.toxic = 1, false) AS supported FROM documents d LEFT JOIN labels l USING (doc_id)),
n AS (SELECT count(*) FILTER (expected = 'positive') AS ap, count(*) FILTER (expected = 'positive' AND selected) AS sp, count(*) FILTER (expected = 'positive' AND investigated) AS ip, count(*) FILTER (expected = 'positive' AND supported) AS up, count(*) FILTER (expected = 'negative' AND supported) AS fp FROM c)
SELECT ap AS applicable_positive, sp AS selected_positive, ip AS investigated_positive, up AS supported_positive, fp AS false_positive_flags, CASE WHEN ap > 0 THEN sp / ap END AS selection_recall, CASE WHEN ip > 0 THEN up / ap END AS detection_recall, CASE WHEN ip > 0 THEN up / ip END AS conditional_detection_recall FROM n""")
def recall_metrics(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("l", F.lit(True)), "doc_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    cases = d.select(F.when(F.col("doc_id") % 6 == 0, "negative").otherwise("positive").alias("expected"), no(F.col("l")).alias("selected"), no(F.col("quality") == 1).alias("investigated"), no((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("supported"))
    return coverage.recall(cases)


@query("""SELECT item_id, CASE WHEN n = 0 THEN 'no_candidate' WHEN sel = 0 THEN CASE WHEN uns THEN 'unsupported_evidence' WHEN exc THEN 'excluded_by_scope' ELSE 'unselected' END WHEN com = 0 THEN CASE WHEN fai THEN 'failed' ELSE 'pending' END
 WHEN out = 0 THEN 'different_operation_reviewed' WHEN sup THEN CASE WHEN item_id % 2 = 0 THEN 'potential_false_positive' ELSE 'supported' END WHEN ref THEN 'refuted' ELSE 'unresolved' END AS status
FROM (SELECT item_id, item_id % 7 AS n, item_id % 5 AS sel, item_id % 4 AS com, item_id % 3 AS out, item_id % 11 = 0 AS uns, item_id % 13 = 0 AS exc, item_id % 8 = 0 AS fai, item_id % 17 < 6 AS sup, item_id % 19 < 9 AS ref FROM benchmark)""")
def case_status(spark, sf):
    i = F.col("item_id")
    status = coverage.case_status(i % 7, i % 5, i % 4, i % 3, i % 17 < 6, i % 19 < 9, i % 8 == 0, i % 11 == 0, i % 13 == 0, i % 2 == 0)
    return table(spark, sf, "benchmark").select("item_id", status.alias("status"))


@query(TASK_SQL + """ SELECT 'tasks' AS report, state AS key, count(*) AS count FROM t GROUP BY 2 UNION ALL SELECT 'subjects_by_purpose', c_mktsegment || '/customer', count(*) FROM customer GROUP BY 2
UNION ALL SELECT 'omitted_files', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'execution', 'outstanding', count(*) FILTER (state <> 'completed') FROM t""")
def coverage_summary(spark, sf):
    subjects = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("purpose"), F.lit("customer").alias("kind"))
    out = coverage.coverage_summary({"tasks": order_tasks(spark, sf), "subjects": subjects, "omissions": table(spark, sf, "events").select(F.col("event_type").alias("reason"))})
    part = lambda name, key: out[name].select(F.lit(name).alias("report"), key.alias("key"), "count")
    execution = out["execution"].select(F.lit("execution").alias("report"), F.lit("outstanding").alias("key"), F.col("outstanding").alias("count"))
    return part("tasks", F.col("state")).unionByName(part("subjects_by_purpose", F.concat_ws("/", "purpose", "kind"))).unionByName(part("omitted_files", F.col("reason"))).unionByName(execution)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem")
def distributed_rank(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    ranked = relations.global_rank(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "rank")
    return ranked.select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


# ---- evidence, names and scopes

@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7")
def edges_touching(spark, sf):
    edges = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return relations.touching(edges, ["l_partkey", "l_suppkey"], 7)


@query("SELECT l_orderkey, l_linenumber, p_brand, p_type FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_retailprice < 950) ON l_partkey = p_partkey")
def imported_names(spark, sf):
    names = table(spark, sf, "part").where("p_retailprice < 950").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    found = relations.looked_up(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), names, ["l_partkey"], ["p_brand", "p_type"])
    return found.drop("l_partkey")


@query("SELECT c_custkey, coalesce(r_name, 'other') AS family FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') ON c_nationkey = n_nationkey")
def sdk_families(spark, sf):
    known = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name != 'ASIA'")
    families = known.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("family"))
    return relations.looked_up(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), families, ["c_nationkey"], ["family"], "other").drop("c_nationkey")


@query("SELECT n_nationkey AS id, c_custkey AS call_id FROM nation JOIN customer ON 'N' || n_nationkey = 'N' || c_nationkey")
def callers_by_name(spark, sf):
    functions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("N"), "n_nationkey").alias("name"))
    calls = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("N"), "c_nationkey").alias("name"))
    return relations.callers(functions, calls).select("id", "call_id")


ORIGIN_SQL = """WITH o AS (SELECT l_partkey AS target, l_suppkey AS file, l_orderkey AS "start", row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey) AS pos
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND s_acctbal >= 0)"""


def part_origins(spark, sf) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("start"), F.col("l_returnflag").alias("kind"))
    contexts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), F.when(F.col("s_acctbal") < 0, "vendor").otherwise(P.PURPOSE_DEFAULT).alias("purpose"))
    return relations.first_origin(edges, contexts, "R", ("application_candidate", "initialization"))


@query(ORIGIN_SQL + ' SELECT target, file, "start" FROM o WHERE pos = 1')
def first_origins(spark, sf):
    return part_origins(spark, sf)


@query(ORIGIN_SQL + """, c AS (SELECT p_partkey AS file, CASE WHEN p_size < 10 THEN 'vendor' WHEN p_size < 30 THEN 'initialization' ELSE 'test_or_fixture' END AS p FROM part),
u AS (SELECT file, p, p <> 'initialization' AND file IN (SELECT target FROM o) AS used FROM c)
SELECT file, CASE WHEN used THEN 'application_candidate' ELSE p END AS purpose, CASE WHEN used THEN p END AS original_purpose FROM u""")
def declared_handlers(spark, sf):
    purpose = F.when(F.col("p_size") < 10, "vendor").when(F.col("p_size") < 30, "initialization").otherwise("test_or_fixture")
    contexts = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), purpose.alias("purpose"))
    return planner.declared_use(contexts, part_origins(spark, sf))


#: Configs and the globs that they exclude, from their own folder.
EXCLUSIONS = (("tsconfig.json", "**.net/en"), ("tsconfig.json", "spam*"), ("en/tsconfig.json", "*"), ("blog.ththan.example.net/tsconfig.json", "en/*"), ("blog.ththan.example.net/en/tsconfig.base.json", "3*"))
CONFIG_ROWS = ", ".join(f"('{c}', '{c.rpartition('/')[0]}', '{P.glob(g)}')" for c, g in EXCLUSIONS)


@query(f"""WITH f AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS file FROM pages), c(config, folder, pattern) AS (VALUES {CONFIG_ROWS}),
h AS (SELECT file, config FROM f JOIN c ON folder = '' OR starts_with(file, folder || '/') WHERE regexp_matches(CASE WHEN folder = '' THEN file ELSE substr(file, length(folder) + 2) END, pattern))
SELECT file, coalesce(string_agg(DISTINCT config, ',' ORDER BY config), '') AS excluded_by FROM f LEFT JOIN h USING (file) GROUP BY 1""")
def config_exclusions(spark, sf):
    files = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    configs = spark.createDataFrame([(c, P.glob(g)) for c, g in EXCLUSIONS], "path string, pattern string")
    return relations.excluded_by(files, configs).select("file", F.concat_ws(",", "excluded_by").alias("excluded_by"))


@query("WITH " + SEARCH_SQL + """ SELECT source || '/' || h.doc_id AS file, "start", "start" + 7 AS "end" FROM hits h JOIN documents d ON d.doc_id = h.doc_id
 WHERE needle = 'the and' AND starts_with(source, 'src1') AND (source || '/' || h.doc_id > 'src11/' OR (source || '/' || h.doc_id = 'src11/' AND "start" > 40)) ORDER BY 1, 2 LIMIT 30""")
def search_page(spark, sf):
    rows = table(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("file"), "text")
    return relations.search(rows, "file", "text", "the and", "src1", "src11/", 40, 30)


#: The same text without its comment, read by DuckDB's own JSON parser.
@query(r"""WITH t AS (SELECT event_id, concat('{"id": ', event_id, ', "props": ', props, ', "tags": [{"kind": "', event_type, '"}, {"more": [', user_id, ', {"last": null}]}]}') AS j FROM events)
SELECT event_id, replace(x.fullkey, '"', '') AS path, replace(x.value::VARCHAR, ' ', '') AS value FROM t, json_tree(t.j) AS x WHERE x.fullkey NOT LIKE '%]' AND x.fullkey <> '$'""")
def json_paths(spark, sf):
    text = F.concat(F.lit('{"id": '), "event_id", F.lit(', "props": '), "props", F.lit(', // {"no": "'), "event_type", F.lit('"}\n "tags": [{"kind": "'), "event_type", F.lit('"}, {"more": ['), "user_id", F.lit(', {"last": null}]}]}'))
    rows = table(spark, sf, "events").select(F.struct("event_id", text.alias("j")).alias("row"), text.alias("j"))
    found = configuration.json_properties(rows, "row", "j")
    path = F.aggregate("path", F.lit("$"), lambda done, x: F.concat(done, F.when(x.startswith("["), x).otherwise(F.concat(F.lit("."), x))))
    value = F.substring(F.col("row.j"), (F.col("value_start") + 1).cast("int"), (F.col("end") - F.col("value_start")).cast("int"))
    return found.select("row.event_id", path.alias("path"), F.replace(value, F.lit(" "), F.lit("")).alias("value"))


RESOURCES = '{"resources": [{"type": "%s", "name": "e%s", "identity": {"type": "u%s"}, "resources": [{"type": "props", "resources": [%s]}, 5]}, "no", {"name": "last"}]}'


@query(f"""WITH RECURSIVE t AS (SELECT event_id, printf('{RESOURCES}', event_type, event_id::VARCHAR, user_id::VARCHAR, props) AS j FROM events),
r AS (SELECT event_id, 0 AS depth, unnest(json_extract(j, '$.resources[*]')) AS v FROM t
 UNION ALL SELECT event_id, depth + 1, unnest(json_extract(v, '$.resources[*]')) FROM r WHERE json_type(v) = 'OBJECT' AND depth < 20)
SELECT event_id, depth, json_extract_string(v, '$.type') AS type, json_extract_string(v, '$.name') AS name, json_extract_string(v, '$.identity.type') AS identity_type FROM r WHERE json_type(v) = 'OBJECT'""")
def nested_resources(spark, sf):
    text = F.format_string(RESOURCES, F.col("event_type"), F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("props"))
    found = configuration.resources(table(spark, sf, "events").select("event_id", text.alias("j")), "event_id", "j")
    return found.where("reason is null").select("event_id", "depth", "type", "name", "identity_type")


#: Where each part of the text begins, from the lengths of those before it.
@query("""WITH t AS (SELECT event_id, length(event_id::VARCHAR) AS n, length(event_type) AS k, length(user_id::VARCHAR) AS u FROM events),
p AS (SELECT *, 5 + n AS props, 5 + n + 13 AS dash FROM t), q AS (SELECT *, dash + 2 AS kind, dash + 8 AS kind_value, dash + 8 + k + 5 AS usr, dash + 8 + k + 5 + 6 AS usr_value FROM p),
r AS (SELECT *, usr_value + u AS usr_end, usr_value + u + 3 + n + 1 + 2 AS dash2 FROM q)
SELECT event_id, x[1]::BIGINT AS "start", x[2]::BIGINT AS "end", CASE x[3] WHEN 0 THEN 'scalar' WHEN 1 THEN 'map' ELSE 'sequence' END AS container FROM (SELECT event_id, unnest([[0, 2, 0], [4, 4 + n, 0], [props, props + 5, 0], [kind, kind + 4, 0],
 [kind_value, kind_value + k, 0], [usr, usr + 4, 0], [usr_value, usr_end, 0], [dash2 + 2, dash2 + 6, 0], [0, dash2 + 6, 1], [dash, dash2 + 6, 2], [kind, usr_end, 1]]) AS x FROM r)""")
def yaml_nodes(spark, sf):
    text = F.concat(F.lit("id: "), "event_id", F.lit("\nprops: # c\n  - kind: "), "event_type", F.lit("\n    user: "), "user_id", F.lit(" # "), "event_id", F.lit("\n  - last\n"))
    return configuration.yaml_nodes(table(spark, sf, "events").select("event_id", text.alias("t")), "event_id", "t")


@query("""WITH f AS (SELECT DISTINCT concat(CASE event_type WHEN 'view' THEN 'dist' WHEN 'click' THEN 'src/Node_Modules' WHEN 'error' THEN 'a/node_modules/b' ELSE 'src' END, '/', user_id, CASE user_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.D.ts' WHEN 2 THEN '.MJS' WHEN 3 THEN '.json' ELSE '.tsx' END) AS path FROM events)
SELECT path, regexp_matches(lower(path), '\.[cm]?[jt]sx?$') AND NOT regexp_matches(lower(path), '\.d\.[cm]?ts$') AS source, len(list_intersect(string_split(path, '/')[1:-2], ['.git', 'node_modules', 'dist', 'build', 'coverage', '.angular', '.cache', 'bin', 'obj'])) > 0 AS excluded FROM f""")
def source_files(spark, sf):
    folder = F.when(F.col("event_type") == "view", "dist").when(F.col("event_type") == "click", "src/Node_Modules").when(F.col("event_type") == "error", "a/node_modules/b").otherwise("src")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".D.ts", ".MJS", ".json", ".tsx")]), (F.col("user_id") % 5 + 1).cast("int"))
    files = table(spark, sf, "events").select(F.concat(folder, F.lit("/"), F.col("user_id").cast("string"), suffix).alias("path")).distinct()
    return files.select("path", P.is_source(F.col("path")).alias("source"), P.in_excluded_directory(F.col("path")).alias("excluded"))


@query(PLAN_SQL + " SELECT id, subject_id, theme, purpose, 'queued' AS state, 'localizer' AS role, priority FROM p WHERE decision = 'deferred'")
def planned_tasks(spark, sf):
    return planner.tasks(planner.plan(*order_subjects(spark, sf), rules=RULES))


#: Every page is a template, every event a JSON text or, one of three, broken.
@query("""WITH f AS (SELECT concat('p', page_id, '.html') AS file, length(html) AS n, 'indexed' AS capability, 'template' AS kind FROM pages
 UNION ALL SELECT concat('e', event_id, CASE event_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '/package.json' ELSE '.toml' END), length(props) - (event_id % 6 = 0)::INT, CASE WHEN event_id % 6 = 0 OR event_id % 3 = 2 THEN 'partial' ELSE 'indexed' END, CASE event_id % 3 WHEN 1 THEN 'dependency_manifest' ELSE 'configuration' END FROM events)
SELECT file, capability, kind, n::BIGINT AS "end" FROM f""")
def context_index(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("text"))
    e = F.col("event_id")
    name = F.concat(F.lit("e"), "event_id", F.when(e % 3 == 0, ".json").when(e % 3 == 1, "/package.json").otherwise(".toml"))
    events = table(spark, sf, "events").select(name.alias("path"), F.when(e % 6 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("text"))
    files = pages.unionByName(events).select("path", "text", F.sha2("text", 256).alias("hash"), P.language(F.col("path")).alias("language"))
    out = context.index(files)
    return out["context_files"].join(out["subjects"], "file").select("file", "capability", "kind", "end")


@query("""SELECT (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS files, (SELECT count(*) FROM documents WHERE lang IS NULL) AS skipped, count(*) AS functions, count(DISTINCT user_id) FILTER (WHERE event_type = 'error') AS files_with_parse_errors FROM events""")
def inventory_counters(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "lang")
    found = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.when(F.col("event_type") == "error", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("parseDiagnostics"))
    return scoring.inventory_counters(d.where("lang is not null"), d.where("lang is null"), found)


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, l_returnflag) AS purpose FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def function_purposes(spark, sf):
    contexts = table(spark, sf, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("purpose"))
    functions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber", F.col("l_returnflag").alias("purpose"))
    return planner.with_purpose(functions, contexts).select(F.col("file").alias("l_orderkey"), "l_linenumber", "purpose")


#: Each order is a result about a span of one file; its customer is the task, with a subject, and for every other nation with what was served.
@query("""WITH r AS (SELECT o_orderkey AS result_id, o_orderstatus, o_orderpriority, o_orderkey % 4 AS f, o_orderkey % 50 AS s, o_orderkey % 50 + 5 AS e, c_custkey % 30 AS a, c_custkey % 30 + 40 AS z, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT result_id, 'invalid_result' AS problem FROM r WHERE o_orderpriority LIKE '5%' UNION ALL SELECT result_id, 'unsupported_candidate' FROM r WHERE o_orderstatus = 'F' AND f = 0 UNION ALL SELECT result_id, 'citation_not_observed' FROM r WHERE c_nationkey % 2 = 1
UNION ALL SELECT result_id, 'citation_hash_mismatch' FROM r WHERE e > 52 UNION ALL SELECT result_id, 'operation_outside_function' FROM r WHERE s < a OR e > z UNION ALL SELECT result_id, 'operation_not_parsed_anchor' FROM r WHERE s >= a AND e <= z AND s % 2 = 1""")
def result_rules(spark, sf):
    customers = table(spark, sf, "customer")
    place = F.col("o_orderkey") % 50
    operation = F.struct(F.lit("f").alias("file"), place.alias("start"), (place + 5).alias("end"), F.lit("h").alias("sourceHash"))
    facts = F.when(F.col("o_orderkey") % 4 != 0, F.array(F.struct(F.lit("t").alias("text"), F.array(operation).alias("citations"))))
    found = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("task_id"), F.lit("challenger").alias("role"), F.when(F.col("o_orderstatus") == "F", "supported_candidate").otherwise("needs_context").alias("disposition"),
        F.when(F.col("o_orderpriority").startswith("5"), "").otherwise("s").alias("summary"), operation.alias("operation"), F.lit("i").alias("invariant"), facts.alias("facts"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in (("assumptions", "array<string>"), ("counterevidence", results.CITED), ("unresolved", "array<string>"), ("flow", results.FLOW), ("follow_ups", results.PROPOSALS))],
    )
    begin = F.col("c_custkey") % 30
    subjects = customers.select(F.col("c_custkey").alias("task_id"), F.col("c_custkey").alias("subject_id"), F.lit("f").alias("file"), begin.alias("start"), (begin + 40).alias("end"))
    served = customers.where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("task_id"), F.lit("f").alias("file"), F.lit(0).alias("start"), F.lit(60).alias("end"), F.lit("h").alias("sourceHash"))
    files = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit("f").alias("file"), F.lit("h").alias("hash"), F.lit(52).alias("length"))
    anchors = table(spark, sf, "nation").select(F.lit("f").alias("file"), (F.col("n_nationkey") * 2).alias("start"), (F.col("n_nationkey") * 2 + 5).alias("end"))
    return results.problems(found, served, files, subjects, subjects, anchors, planner.THEMES)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cleared_files(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return relations.delete_by(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("""SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL WHEN event_type = 'click' THEN 'defects' WHEN event_type = 'view' THEN 'classification' END AS mode FROM events""")
def rubric_modes(spark, sf):
    kind = "map<string,struct<type:string,instructions:string,criteria:map<string,string>>>"
    criteria = lambda labels: F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.lit("c")] * len(labels)))
    asked = F.struct(F.lit("choice").alias("type"), F.when(F.col("user_id") % 7 == 0, " ").otherwise("i").alias("instructions"), F.when(F.col("event_type") == "click", criteria(A.DEFECT_LABELS)).otherwise(criteria(A.PRESENCE_LABELS)).alias("criteria"))
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("input_"), "event_type")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", A.rubric_mode(F.create_map(name, asked).cast(kind)).alias("mode"))


#: Every text is cut as the index cuts it, and every chunk is searched.
@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 8000)) AS s FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, s, string_split(substr(text, s + 1, 8200), 'the ') AS parts FROM c),
h AS (SELECT doc_id, s, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * 4)) AS pos FROM p WHERE len(parts) > 1)
SELECT doc_id::VARCHAR AS file, (s + pos)::BIGINT AS "start", (s + pos + 4)::BIGINT AS "end" FROM h WHERE pos < 8000""")
def indexed_search(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    chunks = cut(search_index.chunked(rows, "file", "text"))
    return search_index.search_all(chunks, search_index.postings(chunks), "the ")


@query("SELECT d.doc_id AS path FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality <> 1")
def index_gaps(spark, sf):
    contexts = table(spark, sf, "labels").select(F.col("doc_id").alias("file"), F.when(F.col("quality") == 1, "indexed").otherwise("partial").alias("capability"))
    return relations.gaps(table(spark, sf, "documents").select(F.col("doc_id").alias("path")), contexts).select("path")


@query(LINES_SQL + ", " + SEARCH_SQL + """ SELECT h.doc_id, h.needle, h."start", l.line, h."start" - l."start" + 1 AS col FROM hits h JOIN lines l ON l.doc_id = h.doc_id AND l."start" <= h."start" AND l."end" >= h."start" + length(h.needle)""")
def line_and_column(spark, sf):
    found = relations.span_join(document_lines(spark, sf), needle_hits(spark, sf), "doc_id", "contains", bucket=4096)
    return found.select("doc_id", F.col("r_needle").alias("needle"), F.col("r_start").alias("start"), "line", (F.col("r_start") - F.col("start") + 1).alias("col"))


@query("""SELECT doc_id, length(substr(text, 1, n)) - length(replace(substr(text, 1, n), chr(10), '')) + 1 AS line, length(string_split(substr(text, 1, n), chr(10))[-1]) + 1 AS col,
 least(2 * n, length(text)) AS "end", greatest(0, 1000 - n) AS remaining FROM (SELECT doc_id, text, (n_chars // 2)::INT AS n FROM documents)""")
def spans_and_budgets(spark, sf):
    n = F.floor(F.col("n_chars") / 2).cast("int")
    d = table(spark, sf, "documents").select("doc_id", "text", n.alias("n"))
    return d.select("doc_id", T.line_of(F.col("text"), F.col("n")).alias("line"), T.column_of(F.col("text"), F.col("n")).alias("col"), T.clamped(2 * F.col("n"), F.col("text")).alias("end"), T.remaining(F.lit(1000), F.col("n")).alias("remaining"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:100], ' ') AS items, CASE WHEN len(string_split(text, ' ')) > 100 THEN 'page_budget' END AS reason FROM documents")
def truncated_lists(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", T.truncated(F.split("text", " ", -1)).alias("t"))
    return cut.select("doc_id", F.concat_ws(" ", "t.items").alias("items"), "t.reason")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages), v AS (SELECT page_id, p FROM p UNION ALL SELECT page_id, '/' || p FROM p UNION ALL SELECT page_id, replace(p, '/', '/../') FROM p UNION ALL SELECT page_id, replace(p, '.', '\\') FROM p)
SELECT page_id, p, p <> '' AND NOT regexp_matches(p, '(^|/)(\\.{1,2})?(/|$)') AND NOT contains(p, '\\') AS safe FROM v""")
def safe_paths(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("p"))
    each = p.select("page_id", F.explode(F.array(F.col("p"), F.concat(F.lit("/"), "p"), F.replace("p", F.lit("/"), F.lit("/../")), F.replace("p", F.lit("."), F.lit("\\")))).alias("p"))
    return each.select("page_id", "p", P.safe_relative(F.col("p")).alias("safe"))


@query("""SELECT page_id, regexp_extract(p, '(\\.[^./]*)$', 1) AS extension, regexp_extract(p, '^(.*)/[^/]*$', 1) AS directory, CASE WHEN starts_with(p, h || '/en/') THEN substr(p, length(h) + 5) ELSE '../' || substr(p, length(h) + 2) END AS relative
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', '') AS p FROM pages) WHERE p <> h""")
def path_parts(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("h"), F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/$", "").alias("p")).where("p != h")
    return p.select("page_id", P.extension(F.col("p")).alias("extension"), P.directory(F.col("p")).alias("directory"), P.relative(F.col("p"), F.concat("h", F.lit("/en"))).alias("relative"))


@query("SELECT page_id, url FROM pages WHERE contains(url, '/en/') ORDER BY page_id LIMIT 40")
def select_by_substring(spark, sf):
    return scoring.select_matching(table(spark, sf, "pages").select("page_id", "url"), "url", "/en/", "page_id", 40)


@query("SELECT doc_id, lang FROM documents")
def without_sources(spark, sf):
    return scoring.without_sources(table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("function"), F.upper("text").alias("body")))


# ---- runs, queues and benchmarks, continued

@query("""SELECT count(*) AS selected, count(*) FILTER (quality = 1) AS evaluated, count(*) FILTER (quality = 1 AND toxic = 1) AS reused, count(*) FILTER (quality = 0) AS failed,
 count(*) FILTER (l.doc_id IS NULL) AS pending, coalesce(sum(d.doc_id) FILTER (quality = 1 AND toxic <> 1), 0)::BIGINT AS new_input_tokens FROM documents d LEFT JOIN labels l USING (doc_id)""")
def run_counters(spark, sf):
    status = F.when(F.col("quality") == 1, "evaluated").otherwise("failed")
    records = table(spark, sf, "labels").select("doc_id", status.alias("status"), (F.col("toxic") == 1).alias("reused"), F.col("doc_id").alias("input_tokens"))
    return scoring.run_counters(table(spark, sf, "documents").select("doc_id"), records, "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'http_500' END AS problem FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR quality = 0")
def failures_and_pending(spark, sf):
    records = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "evaluated").otherwise("failed").alias("status"), F.lit("http_500").alias("error"))
    return scoring.failures_and_pending(table(spark, sf, "documents"), records, "doc_id")


@query("""SELECT o_custkey, CASE WHEN b > 0 THEN 'blocked' WHEN i > 0 THEN 'interrupted' WHEN f + p > 0 THEN 'partial' ELSE 'complete' END AS status FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 250000) AS b,
 count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 150000) AS i, count(*) FILTER (o_orderpriority LIKE '1%' AND o_totalprice > 200000) AS f, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000) AS p FROM orders GROUP BY 1)""")
def run_statuses(spark, sf):
    n = lambda c: F.sum(F.expr(c).cast("long"))
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(
        n("o_orderstatus = 'P' and o_totalprice > 250000").alias("blocked"), n("o_orderstatus = 'P' and o_totalprice > 150000").alias("interrupted"),
        n("o_orderpriority like '1%' and o_totalprice > 200000").alias("failed"), n("o_orderstatus = 'O' and o_totalprice > 200000").alias("pending"),
    )
    return scoring.run_status(counts).select("o_custkey", "status")


@query("SELECT o_orderkey, printf('%.3f', o_totalprice) AS price FROM orders")
def fixed_decimals(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.fixed3(F.col("o_totalprice")).alias("price"))


@query("SELECT o_orderpriority AS kind, count(*) AS count FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def subjects_by_kind(spark, sf):
    subjects = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("file"))
    return coverage.by_kind(subjects, table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("file")))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS distinct_count FROM lineitem GROUP BY 1")
def distinct_themes(spark, sf):
    return coverage.distinct_per(table(spark, sf, "lineitem"), "l_returnflag", "l_partkey")


@query(TASK_SQL + """ SELECT id, CASE WHEN hit THEN 'failed' ELSE state END AS state, CASE WHEN hit THEN 'timeout' END AS error, CASE WHEN hit THEN NULL ELSE deadline END AS deadline
 FROM (SELECT *, coalesce(state = 'running' AND role <> 'challenger', false) AS hit FROM t)""")
def fail_tasks(spark, sf):
    tasks = order_tasks(spark, sf)
    errors = tasks.where("state = 'running'").select("id", F.when(F.col("role") == "challenger", "old").otherwise(F.col("attempt")).alias("attempt"), F.lit("timeout").alias("error"))
    return lifecycle.fail(tasks, errors).select("id", "state", "error", "deadline")


@query(TASK_SQL + """, n AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT t.*, coalesce(n.n, 0) AS n, CASE role WHEN 'challenger' THEN 'investigator' ELSE role END AS back FROM t LEFT JOIN n ON t.id = n.id AND CASE t.role WHEN 'challenger' THEN 'investigator' ELSE t.role END = 'investigator'),
x AS (SELECT *, state = 'completed' AND n < 3 AND priority IN (1, 2) AS again FROM b) SELECT id, CASE WHEN again THEN 'queued' ELSE state END AS state, CASE WHEN again THEN back ELSE role END AS role FROM x""")
def continue_inconclusive(spark, sf):
    tasks = order_tasks(spark, sf)
    attempts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.lit("investigator").alias("role"))
    disposition = F.when(F.col("priority") == 1, "needs_context").when(F.col("priority") == 2, "budget_exhausted").otherwise("supported_candidate")
    return lifecycle.continue_inconclusive(tasks, attempts, tasks.select(F.col("id").alias("task_id"), disposition.alias("disposition"))).select("id", "state", "role")


@query("""WITH d AS (SELECT l_orderkey AS c, max(l_linenumber) AS d FROM lineitem GROUP BY 1) SELECT o_orderkey AS task_id, coalesce(d, 0) + 1 AS depth, CASE WHEN coalesce(d, 0) + 1 > 3 THEN 'depth_limited' ELSE 'proposed' END AS state
FROM orders LEFT JOIN d ON o_orderkey = c WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def follow_up_depths(spark, sf):
    proposals = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("theme"))
    parents = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_linenumber").alias("depth"))
    return lifecycle.follow_ups(proposals, parents, ["1-URGENT", "2-HIGH"]).select("task_id", "depth", "state")


@query("""WITH f AS (SELECT 'f' || c_custkey AS id, c_nationkey AS subject_id, 'k' || (c_custkey % 3) AS key, c_custkey % 4 AS s, c_mktsegment AS theme, c_custkey % 5 AS depth, c_acctbal > 0 AS open FROM customer WHERE c_custkey BETWEEN 1 AND 100),
c AS (SELECT 'c' || s_suppkey AS c, s_nationkey AS subject_id, 'BUILDING' AS theme, s_suppkey % 4 AS s, CASE WHEN s_acctbal > 3000 THEN 'k' || (s_suppkey % 3) END AS key FROM supplier),
k AS (SELECT f.id, min(c) AS c FROM f JOIN c ON f.theme = c.theme AND f.subject_id = c.subject_id AND (f.s = c.s OR f.key = c.key) GROUP BY 1)
SELECT f.id, CASE WHEN good THEN k.c END AS candidate_id, CASE WHEN NOT good THEN 'rejected' WHEN k.c IS NOT NULL THEN 'known' ELSE 'admitted' END AS action FROM (SELECT *, open AND depth <= 3 AND theme IN ('BUILDING', 'MACHINERY') AS good FROM f) f LEFT JOIN k ON f.id = k.id""")
def approve_followups(spark, sf):
    key = F.col("c_custkey")
    followups = table(spark, sf, "customer").select(
        F.concat(F.lit("f"), key).alias("id"), F.col("c_nationkey").alias("subject_id"), F.concat(F.lit("k"), key % 3).alias("operation_key"), (key % 4).alias("start"), (key % 4 + 5).alias("end"),
        F.col("c_mktsegment").alias("theme"), (key % 5).alias("depth"), F.when(F.col("c_acctbal") > 0, "proposed").otherwise("approved").alias("state"),
    )
    key, s = F.col("s_suppkey"), table(spark, sf, "supplier")
    candidates = s.select(F.concat(F.lit("c"), key).alias("candidate_id"), F.lit("BUILDING").alias("theme"), F.col("s_nationkey").alias("subject_id"), (key % 4).alias("start"), (key % 4 + 5).alias("end"))
    results = s.where("s_acctbal > 3000").select(F.concat(F.lit("c"), key).alias("task_id"), F.concat(F.lit("k"), key % 3).alias("operation_key"))
    return lifecycle.approve(followups, [f"f{i}" for i in range(1, 101)], candidates, results, ["BUILDING", "MACHINERY"])


CASES_SQL = """WITH cases AS (SELECT item_id AS case_id, CASE WHEN item_id % 4 = 0 THEN 'negative' ELSE 'positive' END AS expected, item_id % 50 AS file, item_id * 20 % 1000 AS a, item_id * 20 % 1000 + 40 AS b FROM benchmark),
c AS (SELECT o_orderkey AS id, o_custkey % 50 AS file, o_orderkey % 1000 AS a, o_orderkey % 1000 + 30 AS b, o_orderpriority AS theme, CASE o_orderstatus WHEN 'O' THEN 'excluded' ELSE 'selected' END AS decision,
 CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'refuted_hypothesis' WHEN o_orderkey % 3 = 1 THEN 'supported_candidate' ELSE 'needs_context' END AS disposition,
 CASE WHEN o_totalprice > 100000 THEN o_custkey % 50 END AS op FROM orders),
j AS (SELECT case_id, expected, c.*, cases.file AS f, coalesce(state = 'completed', false) AS done, op IS NULL OR (op = cases.file AND c.a + 10 <= cases.b AND c.a + 20 > cases.a) AS about FROM cases LEFT JOIN c
 ON cases.file = c.file AND c.a <= cases.b AND c.b > cases.a AND theme IN ('1-URGENT', '3-MEDIUM')),
g AS (SELECT case_id, expected, count(id) AS candidates, count(state) AS chosen, count(*) FILTER (done) AS done, count(*) FILTER (done AND about) AS out, count(*) FILTER (done AND about AND disposition = 'supported_candidate') AS yes,
 count(*) FILTER (done AND about AND disposition = 'refuted_hypothesis') AS no, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (decision = 'excluded') AS exc FROM j GROUP BY 1, 2)
SELECT case_id, expected, candidates, CASE WHEN candidates = 0 THEN 'no_candidate' WHEN chosen = 0 THEN CASE WHEN exc = candidates THEN 'excluded_by_scope' ELSE 'unselected' END WHEN done = 0 THEN CASE WHEN failed > 0 THEN 'failed' ELSE 'pending' END
 WHEN out = 0 THEN 'different_operation_reviewed' WHEN yes > 0 THEN CASE expected WHEN 'negative' THEN 'potential_false_positive' ELSE 'supported' END WHEN no > 0 THEN 'refuted' ELSE 'unresolved' END AS status, chosen > 0 AS selected, out > 0 AS investigated, yes > 0 AS supported FROM g"""


def order_cases(spark, sf) -> DataFrame:
    i, key, o = F.col("item_id"), F.col("o_orderkey"), table(spark, sf, "orders")
    cases = table(spark, sf, "benchmark").select(i.alias("case_id"), F.when(i % 4 == 0, "negative").otherwise("positive").alias("expected"), (i % 50).alias("file"), (i * 20 % 1000).alias("start"), (i * 20 % 1000 + 40).alias("end"), F.array(F.lit("1-URGENT"), F.lit("3-MEDIUM")).alias("themes"))
    candidates = o.select(key.alias("id"), key.alias("subject_id"), F.col("o_orderpriority").alias("theme"), F.when(F.col("o_orderstatus") == "O", "excluded").otherwise("selected").alias("decision"))
    subjects = o.select(key.alias("subject_id"), (F.col("o_custkey") % 50).alias("file"), (key % 1000).alias("start"), (key % 1000 + 30).alias("end"))
    tasks = o.where("o_orderstatus != 'O'").select(key.alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("state"))
    disposition = F.when(key % 3 == 0, "refuted_hypothesis").when(key % 3 == 1, "supported_candidate").otherwise("needs_context")
    op = F.when(F.col("o_totalprice") > 100000, F.col("o_custkey") % 50)
    results = o.where("o_orderstatus = 'F'").select(key.alias("task_id"), disposition.alias("disposition"), op.alias("op_file"), F.when(op.isNotNull(), key % 1000 + 10).alias("op_start"), F.when(op.isNotNull(), key % 1000 + 20).alias("op_end"))
    return coverage.evaluate_cases(cases, candidates, subjects, tasks, results)


@query(CASES_SQL)
def benchmark_cases(spark, sf):
    return order_cases(spark, sf)


@query("""WITH c(theme, text) AS (VALUES ('1-URGENT', 'look now'), ('3-MEDIUM', 'look soon')) SELECT o_orderkey, coalesce(text, 'look') AS contract FROM orders LEFT JOIN c ON o_orderpriority = theme""")
def review_contracts(spark, sf):
    texts = spark.createDataFrame([("1-URGENT", "look now"), ("3-MEDIUM", "look soon")], "theme string, text string")
    return coverage.contract(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("theme")), texts, "look").select("o_orderkey", "contract")


@query(TASK_SQL + """, done AS (SELECT l_returnflag AS disposition, l_partkey AS k FROM lineitem JOIN t ON t.id = l_orderkey AND t.state = 'completed')
SELECT 'dispositions' AS report, disposition AS key, count(*) AS count FROM done GROUP BY 2 UNION ALL SELECT 'catalogue', o_orderstatus, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'candidates_by_theme', o_orderpriority || '/' || o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'followups', event_type, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'capabilities', role || '/none', count(*) FROM conversations GROUP BY 2 UNION ALL SELECT 'files_without_subjects', lang, count(*) FROM documents WHERE doc_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
UNION ALL SELECT 'execution', 'drained', count(*) FILTER (false) FROM t UNION ALL SELECT 'operation_groups', 'distinct_operations', count(DISTINCT k) FROM done
UNION ALL SELECT 'operation_groups', 'repeated_groups', count(*) FROM (SELECT k FROM done GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'usage', 'reported_input', sum(user_id)::BIGINT FROM events""")
def coverage_reports(spark, sf):
    o, e = table(spark, sf, "orders"), table(spark, sf, "events")
    results = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_returnflag").alias("disposition"), F.col("l_partkey").alias("operation_key"))
    out = coverage.coverage_summary({
        "tasks": order_tasks(spark, sf), "task_results": results, "candidates": o.select(F.col("o_orderpriority").alias("theme"), F.col("o_orderstatus").alias("decision")),
        "followups": e.select(F.col("event_type").alias("state")), "coverage": table(spark, sf, "conversations").select(F.col("role").alias("capability"), F.lit("none").alias("reasons")),
        "files": table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("language")),
        "subjects": table(spark, sf, "customer").select(F.col("c_custkey").alias("file"), F.lit("p").alias("purpose"), F.lit("k").alias("kind")),
        "usage": e.select(F.col("user_id").alias("input_tokens"), F.col("user_id").alias("output_tokens")),
    })
    keys = {"dispositions": "disposition", "catalogue": "decision", "candidates_by_theme": "theme || '/' || decision", "followups": "state", "capabilities": "capability || '/' || reasons", "files_without_subjects": "language"}
    parts = [out[name].select(F.lit(name).alias("report"), F.expr(key).alias("key"), "count") for name, key in keys.items()]
    value = lambda name, column, key: out[name].select(F.lit(name).alias("report"), F.lit(key).alias("key"), F.col(column).cast("long").alias("count"))
    parts += [value("execution", "queue_drained", "drained"), value("operation_groups", "distinct_operations", "distinct_operations"), value("operation_groups", "repeated_groups", "repeated_groups"), value("usage", "reported_input", "reported_input")]
    return functools.reduce(DataFrame.unionByName, parts)
