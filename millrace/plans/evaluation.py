"""Queries of evaluation, splits, audits and gates: E*, L*, M1, W8-W11 and J*."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, protocols, splits
from ..sources import readers
from ..tables import table
from .base import query, r, rounded

CLASSES = ["click", "error", "purchase", "signup", "view"]
FAULTS = "kind IN ('error', 'purchase')"


def predictions(spark, sf_dir):
    """events as predictions: class, probabilities that lean to it, and the answers of two models."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("y_true"), F.col("value").alias("v"))
    raw = [1 + F.pmod(F.col("event_id") * (i + 3) + F.floor("v"), F.lit(17 + i)) + F.when((F.col("y_true") == c) & (F.col("event_id") % 3 != 0), 12).otherwise(0) for i, c in enumerate(CLASSES)]
    e = e.withColumn("raw", F.array(*raw))
    e = e.withColumn("proba", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0).cast("long"), lambda a, b: a + b)))
    e = e.withColumn("confidence", F.array_max("proba"))
    top = F.get(F.array(*map(F.lit, CLASSES)), (F.array_position("proba", F.col("confidence")) - 1).cast("int"))
    e = e.withColumns({"top": top, "y_pred": F.when(F.col("confidence") < 0.28, metrics.ABSTAIN).otherwise(top)})
    return e.withColumns({"other": F.when(F.col("event_id") % 4 == 0, "view").otherwise(F.col("top")), "severity": F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 3).cast("int"))})


RAW = ", ".join(f"1 + (event_id * {i + 3} + floor(value)::BIGINT) % {17 + i} + CASE WHEN event_type = '{c}' AND event_id % 3 <> 0 THEN 12 ELSE 0 END" for i, c in enumerate(CLASSES))
NAMES = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
PREDICTIONS = f"""
a AS (SELECT event_id, event_type AS y_true, [{RAW}] AS raw FROM events),
b AS (SELECT *, list_transform(raw, lambda x: x::DOUBLE / list_sum(raw)::DOUBLE) AS proba FROM a),
c AS (SELECT *, list_max(proba) AS confidence, {NAMES}[list_position(proba, list_max(proba))] AS top FROM b),
p AS (SELECT *, CASE WHEN confidence < 0.28 THEN 'ABSTAIN' ELSE top END AS y_pred, CASE WHEN event_id % 4 = 0 THEN 'view' ELSE top END AS other,
      CASE WHEN event_id % 5 > 0 THEN (event_id % 3)::INT END AS severity FROM c)"""
PER_CLASS = f"""
{PREDICTIONS}, k AS (SELECT y_true, y_pred FROM p WHERE y_pred <> 'ABSTAIN'), u AS (SELECT DISTINCT unnest([y_true, y_pred]) AS class FROM k),
f AS (SELECT class, count(*) FILTER (y_true = class AND y_pred = class) AS tp, count(*) FILTER (y_true <> class AND y_pred = class) AS fp, count(*) FILTER (y_true = class AND y_pred <> class) AS fn
      FROM u, k GROUP BY class)"""


@query("e1_confusion", f"WITH {PREDICTIONS} SELECT y_true AS \"true\", y_pred AS pred, count(*)::BIGINT AS n FROM p WHERE y_pred <> 'ABSTAIN' GROUP BY ALL")
def confusion(spark, sf_dir):
    """Confusion table without abstentions."""
    return metrics.confusion(predictions(spark, sf_dir))


@query("e1_per_class", f"WITH {PER_CLASS} SELECT class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, (tp + fn)::BIGINT AS support FROM f")
def per_class(spark, sf_dir):
    """Precision, recall and F1 of each class."""
    return rounded(metrics.per_class(metrics.confusion(predictions(spark, sf_dir))), "precision", "recall", "f1")


@query("e1_report", f"""WITH {PER_CLASS}, s AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM f)
SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1,
       round((SELECT count(*) FILTER (y_pred <> 'ABSTAIN') / count(*) FROM p), 6) AS coverage, (SELECT count(*) FILTER (y_pred = 'ABSTAIN') FROM p)::BIGINT AS n_abstained FROM s""")
def report(spark, sf_dir):
    """Accuracy, F1 and coverage."""
    return rounded(metrics.report(predictions(spark, sf_dir)), "accuracy", "macro_f1", "weighted_f1", "coverage")


ONE_VS_REST = f"""{PREDICTIONS}, o AS (SELECT unnest({NAMES}) AS class, unnest(proba) AS score, y_true FROM p),
h AS (SELECT class, score, count(*) FILTER (y_true = class) AS p, count(*) FILTER (y_true <> class) AS q FROM o GROUP BY ALL),
w AS (SELECT *, sum(p) OVER d AS tp, sum(q) OVER d AS fp, sum(p) OVER g AS pos, sum(q) OVER g AS neg FROM h WINDOW d AS (PARTITION BY class ORDER BY score DESC), g AS (PARTITION BY class))"""


@query("e2_average_precision", f"WITH {ONE_VS_REST} SELECT class, round(sum(p / pos * tp / (tp + fp)), 6) AS ap FROM w WHERE pos > 0 AND neg > 0 GROUP BY class")
def average_precision(spark, sf_dir):
    """Stepwise average precision of each class."""
    return rounded(metrics.average_precision(predictions(spark, sf_dir), CLASSES), "ap")


@query("e3_roc_auc", f"WITH {ONE_VS_REST} SELECT class, round(sum(p * (neg - fp + q / 2)) / max(pos * neg), 6) AS auc FROM w WHERE pos > 0 AND neg > 0 GROUP BY class")
def roc_auc(spark, sf_dir):
    """Area under the ROC curve of each class."""
    return rounded(metrics.roc_auc(predictions(spark, sf_dir), CLASSES), "auc")


BINS = f"""{PREDICTIONS}, i AS (SELECT confidence, (top = y_true)::INT AS good, {" + ".join(f"(confidence > {i / 10})::INT" for i in range(1, 10))} AS bin FROM p),
g AS (SELECT bin, count(*) AS n, avg(confidence) AS c, avg(good) AS a FROM i GROUP BY bin)"""


@query("e5_calibration_bins", f"WITH {BINS} SELECT r.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN g USING (bin)")
def calibration(spark, sf_dir):
    """Confidence and accuracy of ten bins, empty ones too."""
    return rounded(metrics.calibration_bins(predictions(spark, sf_dir), F.col("confidence"), F.col("top") == F.col("y_true")), "confidence", "accuracy")


@query("e4_calibration_error", f"WITH {BINS} SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM g")
def calibration_error(spark, sf_dir):
    """Expected calibration error."""
    return rounded(metrics.calibration_error(metrics.calibration_bins(predictions(spark, sf_dir), F.col("confidence"), F.col("top") == F.col("y_true"))), "ece")


@query("e6_brier", f"WITH {PREDICTIONS} SELECT round(avg(list_sum(list_transform(proba, lambda x, i: (x - ({NAMES}[i] = y_true)::INT) ** 2))), 6) AS brier FROM p")
def brier(spark, sf_dir):
    """Multiclass Brier score."""
    return rounded(metrics.brier(predictions(spark, sf_dir), CLASSES), "brier")


@query("e7_risk_coverage", f"""WITH {PREDICTIONS}, k AS (SELECT row_number() OVER o AS rank, sum((top <> y_true)::INT) OVER (ORDER BY confidence DESC, event_id) AS wrong FROM p WINDOW o AS (ORDER BY confidence DESC, event_id)),
n AS (SELECT count(*) AS n FROM p), q AS (SELECT DISTINCT n, floor(1 + (n - 1) * i / 19)::BIGINT AS rank FROM n, (SELECT unnest(range(20)) AS i))
SELECT round(q.rank / n, 6) AS coverage, round(wrong / q.rank, 6) AS risk FROM q JOIN k ON k.rank = q.rank""")
def risk_coverage(spark, sf_dir):
    """Risk at twenty coverages."""
    return rounded(metrics.risk_coverage(predictions(spark, sf_dir), "confidence", F.col("top") == F.col("y_true"), "event_id"), "coverage", "risk")


BUDGETS = {1080: 1 / 1080, 360: 1 / 360, 90: 1 / 90, 30: 1 / 30, 12: 1 / 12}


@query("e8_e11_recall_at_budget", f"""WITH {PREDICTIONS}, s AS (SELECT 1 - proba[5] AS score, count(*) FILTER (y_true <> 'view') AS p, count(*) FILTER (y_true = 'view') AS q FROM p GROUP BY 1),
w AS (SELECT score, sum(p) OVER (ORDER BY score DESC) / sum(p) OVER () AS recall, sum(q) OVER (ORDER BY score DESC) / sum(q) OVER () AS far FROM s),
bud AS (SELECT unnest([{", ".join(map(str, BUDGETS))}]) AS decisions), j AS (SELECT decisions, recall, far, score, row_number() OVER (PARTITION BY decisions ORDER BY recall DESC, score) AS n FROM bud LEFT JOIN w ON far <= 1.0::DOUBLE / decisions)
SELECT decisions::INT AS decisions, round(coalesce(recall, 0), 6) AS recall, round(coalesce(far, 0), 6) AS far, round(score, 6) AS threshold FROM j WHERE n = 1""")
def recall_at_budget(spark, sf_dir):
    """Recall at one false alarm a month for five decision rates."""
    score = 1 - F.get("proba", F.lit(4))
    out = metrics.recall_at_far(predictions(spark, sf_dir), F.col("y_true") != "view", score, list(BUDGETS.values()))
    out = out.withColumn("decisions", F.round(1 / F.col("max_far")).cast("int")).withColumn("threshold", F.when(F.col("threshold") != float("inf"), F.col("threshold")))
    return rounded(out.select("decisions", "recall", "far", "threshold"), "recall", "far", "threshold")


@query("e12_mcnemar", f"""WITH {PREDICTIONS}, n AS (SELECT count(*) FILTER (top <> y_true AND other = y_true)::BIGINT AS n01, count(*) FILTER (top = y_true AND other <> y_true)::BIGINT AS n10 FROM p)
SELECT n01, n10, round(CASE WHEN n01 + n10 = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(n01, n10) + 1), lambda k: exp(lgamma(n01 + n10 + 1) - lgamma(k + 1) - lgamma(n01 + n10 - k + 1) - (n01 + n10) * ln(2))))) END, 6) AS p FROM n""")
def mcnemar(spark, sf_dir):
    """The exact test of two models: rows that only one gets right, and p."""
    return rounded(metrics.mcnemar(predictions(spark, sf_dir), "y_true", "top", "other"), "p")


STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


@query("e13_bootstrap", f"""WITH d AS (SELECT value, b, ((event_id % 2147483648)::UBIGINT * 2654435761 + b * 40503) & 4294967295 AS x FROM events, (SELECT unnest(range(200))::UBIGINT AS b)),
e AS (SELECT value, b, (xor(x, x >> 16) * 2246822519) & 4294967295 AS x FROM d), f AS (SELECT value, b, (xor(x, x >> 13) * 3266489917) & 4294967295 AS x FROM e),
g AS (SELECT value, b, xor(x, x >> 16)::DOUBLE / 4294967296 AS u FROM f), t AS (SELECT value, b, {" + ".join(f"(u > {s!r}::DOUBLE)::INT" for s in STEPS)} AS t FROM g),
m AS (SELECT b, sum(value * t) / sum(t) AS m FROM t GROUP BY b) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(m), 6) AS mean FROM m""")
def bootstrap(spark, sf_dir):
    """Interval of the mean reading from 200 replicates."""
    return rounded(protocols.bootstrap(table(spark, sf_dir, "events"), "value", 200, row="event_id"), "low", "high", "mean")


@query("e14_severity", f"WITH {PREDICTIONS} SELECT severity, count(*)::BIGINT AS n, round(avg((y_pred NOT IN ('view', 'ABSTAIN'))::INT), 6) AS detected, round(avg((y_pred = y_true)::INT), 6) AS right_class FROM p WHERE y_true <> 'view' AND severity IS NOT NULL GROUP BY severity")
def severity(spark, sf_dir):
    """Detection of faults by severity."""
    return rounded(metrics.by_severity(predictions(spark, sf_dir), "y_true", "y_pred", "severity", "view"), "detected", "right_class")


@query("e19_seed_spread", "SELECT event_type AS kind, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def seed_spread(spark, sf_dir):
    """Mean, deviation and range of a metric."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "value")
    return rounded(metrics.seed_spread(e, ["kind"], "value"), "mean", "std")


@query("e15_leakage_inflation", "WITH s AS (SELECT event_type AS kind, (user_id % 4)::INT AS level, avg(value) AS f1 FROM events GROUP BY ALL) SELECT kind, round(max(f1) FILTER (level = 0) / max(f1) FILTER (level = 3), 6) AS inflation FROM s GROUP BY kind")
def leakage_inflation(spark, sf_dir):
    """Score at level 0 over that at the strictest level."""
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 4).alias("level")).agg(F.avg("value").alias("f1"))
    return rounded(metrics.leakage_inflation(s, ["kind"], "level", "f1"), "inflation")


@query("m1_majority", "WITH c AS (SELECT user_id AS machine, event_type AS label, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY n DESC, label) AS i, sum(n) OVER (PARTITION BY machine) AS t FROM c) SELECT machine, label, round(n / t, 6) AS share FROM k WHERE i = 1")
def majority(spark, sf_dir):
    """Most frequent class of each machine."""
    return rounded(metrics.majority(table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), F.col("event_type").alias("label")), ["machine"], "label"), "share")


def rows(spark, sf_dir):
    """events as rows of machines with a class and two features."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row"), (F.col("user_id") % 12).cast("int").alias("machine"), F.col("event_type").alias("label"), F.col("value").alias("x"), (F.col("value") * 0.5 + F.col("event_id") % 10).alias("y"))


ROWS = "r AS (SELECT event_id AS row, (user_id % 12)::INT AS machine, event_type AS label, value AS x, value * 0.5 + event_id % 10 AS y FROM events)"
HASH = "(({x} % 2147483648) * 2654435761) % 4294967296"
FOLDS = f"{ROWS}, g AS (SELECT machine, ((row_number() OVER (ORDER BY {HASH.format(x='machine')}, machine) - 1) % {{k}})::INT AS own FROM (SELECT DISTINCT machine FROM r)), t AS (SELECT r.*, f.fold, CASE WHEN g.own = f.fold THEN 'test' ELSE 'train' END AS role FROM r JOIN g USING (machine), (SELECT DISTINCT own AS fold FROM g) f)"


@query("l0_random_split", f"WITH {ROWS}, k AS (SELECT row, row_number() OVER (ORDER BY {HASH.format(x='row')}, row) AS i, count(*) OVER () AS n FROM r) SELECT row, CASE WHEN i <= greatest(1, floor(n * 0.3)) THEN 'test' ELSE 'train' END AS role FROM k")
def random_split(spark, sf_dir):
    """Role of each row in a random split."""
    return splits.random_split(rows(spark, sf_dir), "row").select("row", "role")


@query("l1_group_folds", f"WITH {FOLDS.format(k=10)} SELECT fold, role, count(*)::BIGINT AS n, count(DISTINCT machine)::BIGINT AS n_machines, list_sort(list(DISTINCT label)) AS classes FROM t GROUP BY fold, role")
def group_folds(spark, sf_dir):
    """Folds of machines, binned to ten."""
    df = rows(spark, sf_dir)
    return splits.describe_group_folds(df, splits.group_folds(df, "machine", most=10), "machine", "label")


@query("l3_leave_one_out", f"WITH {FOLDS.format(k=1000)} SELECT fold, role, count(*)::BIGINT AS n, count(DISTINCT machine)::BIGINT AS n_machines, list_sort(list(DISTINCT label)) AS classes FROM t GROUP BY fold, role")
def leave_one_out(spark, sf_dir):
    """A fold for each machine."""
    df = rows(spark, sf_dir)
    return splits.describe_group_folds(df, splits.group_folds(df, "machine", most=0), "machine", "label")


def relabelled(spark, sf_dir, rule, to):
    """All rows; the label of those that meet the rule is another, so that classes are uneven and no row is lost."""
    return rows(spark, sf_dir).withColumn("label", F.when(F.expr(rule), to).otherwise(F.col("label")))


def relabelled_sql(rule, to):
    return f"{ROWS}, s AS (SELECT row, machine, CASE WHEN {rule} THEN '{to}' ELSE label END AS label FROM r)"


ERROR_ON_ONE = "label = 'error' and machine <> 1"


@query("l5_label_coverage", f"WITH {relabelled_sql(ERROR_ON_ONE, 'click')}, g AS (SELECT machine, (row_number() OVER (ORDER BY {HASH.format(x='machine')}, machine) - 1)::INT AS own FROM (SELECT DISTINCT machine FROM s)), c AS (SELECT f.own AS fold, label, count(*) FILTER (g.own = f.own) AS te, count(*) FILTER (g.own <> f.own) AS tr FROM s JOIN g USING (machine), g f GROUP BY ALL) SELECT fold, sum(te)::BIGINT AS n_test, coalesce(sum(te) FILTER (te > 0 AND tr = 0), 0)::BIGINT AS n_lost, coalesce(list_sort(list(label) FILTER (te > 0 AND tr = 0)), []) AS missing, coalesce(sum(te) FILTER (te > 0 AND tr = 0), 0) / sum(te) < 0.1 AS interpretable FROM c GROUP BY fold")
def label_coverage(spark, sf_dir):
    """Test classes that training lacks, over all rows."""
    df = relabelled(spark, sf_dir, ERROR_ON_ONE, "click")
    return splits.fold_coverage(df, splits.group_folds(df, "machine", most=0), "machine", "label").drop("share_lost")


def normalise_sql(key, inner):
    return f"WITH {FOLDS.format(k=10)}, m AS (SELECT {key}, {inner}) SELECT row, t.fold, role, round((x - mx) / CASE WHEN sx < 1e-9 THEN 1 ELSE sx END, 6) AS x, round((y - my) / CASE WHEN sy < 1e-9 THEN 1 ELSE sy END, 6) AS y FROM t JOIN m USING ({key})"


TRAIN = "FILTER (role = 'train')"


@query("l7_normalise_pooled", normalise_sql("fold", f"avg(x) {TRAIN} AS mx, stddev_pop(x) {TRAIN} AS sx, avg(y) {TRAIN} AS my, stddev_pop(y) {TRAIN} AS sy FROM t GROUP BY fold"))
def normalise_pooled(spark, sf_dir):
    """z-scores of each fold by its training rows."""
    df = rows(spark, sf_dir)
    return rounded(splits.normalised_folds(df, splits.group_folds(df, "machine", most=10), "machine", ["x", "y"], "train_pooled").select("row", "fold", "role", "x", "y"), "x", "y")


@query("l7_normalise_per_machine", normalise_sql("fold, machine", f"coalesce(avg(x) {TRAIN}, avg(x)) AS mx, coalesce(stddev_pop(x) {TRAIN}, stddev_pop(x)) AS sx, coalesce(avg(y) {TRAIN}, avg(y)) AS my, coalesce(stddev_pop(y) {TRAIN}, stddev_pop(y)) AS sy FROM t GROUP BY fold, machine"))
def normalise_per_machine(spark, sf_dir):
    """z-scores of each fold by each machine's own rows."""
    df = rows(spark, sf_dir)
    return rounded(splits.normalised_folds(df, splits.group_folds(df, "machine", most=10), "machine", ["x", "y"], "unsupervised_per_machine").select("row", "fold", "role", "x", "y"), "x", "y")


UNEVEN = "machine % 5 = length(label) % 5"


@query("l8_nth_of_class", f"WITH {relabelled_sql(UNEVEN, 'signup')}, u AS (SELECT DISTINCT machine, label FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY machine) - 1 AS fold FROM u), m AS (SELECT min(c) AS folds FROM (SELECT count(*) AS c FROM u GROUP BY label)) SELECT machine, label, fold::INT AS fold FROM k, m WHERE fold < folds")
def nth_of_class(spark, sf_dir):
    """The k-th machine of every class as fold k, over all rows."""
    return splits.nth_of_class(relabelled(spark, sf_dir, UNEVEN, "signup"), "machine", "label").select("machine", "label", F.col("fold").cast("int").alias("fold"))


@query("l9_balanced", f"WITH {ROWS}, c AS (SELECT machine, label, count(*) AS c FROM r GROUP BY ALL HAVING count(*) >= 8), m AS (SELECT *, count(*) OVER (PARTITION BY machine) AS k, min(c) OVER (PARTITION BY machine) AS m FROM c), n AS (SELECT r.*, m.m, row_number() OVER (PARTITION BY machine, label ORDER BY {HASH.format(x='row')}, row) AS i FROM r JOIN m USING (machine, label) WHERE k >= 2) SELECT row, machine, label FROM n WHERE i <= m")
def balanced(spark, sf_dir):
    """As many rows of each class on each machine."""
    return splits.balanced(rows(spark, sf_dir), "machine", "label", "row").select("row", "machine", "label")


@query("l10_dominant_share", f"WITH {ROWS}, c AS (SELECT machine, label, count(*) AS c FROM r GROUP BY ALL), s AS (SELECT max(c) / sum(c) AS s FROM c GROUP BY machine) SELECT round(avg(s), 6) AS dominant_share FROM s")
def dominant_share(spark, sf_dir):
    """Mean share of each machine's most frequent class."""
    return rounded(splits.dominant_share(rows(spark, sf_dir), "machine", "label"), "dominant_share")


MOST_ERRORS = "label = 'error' and row % 100 <> 0"


@query("l11_stratified_context", f"""WITH {relabelled_sql(MOST_ERRORS, 'click')}, c AS (SELECT label, count(*) AS c FROM s GROUP BY label), b AS (SELECT *, least(500 // count(*) OVER (), c) AS base FROM c),
e AS (SELECT *, coalesce(sum(c - base) OVER (ORDER BY c DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 500 - sum(base) OVER () AS spare FROM b), q AS (SELECT label, base + greatest(0, least(c - base, spare - before)) AS quota FROM e),
n AS (SELECT s.*, quota, row_number() OVER (PARTITION BY label ORDER BY {HASH.format(x='row')}, row) AS i FROM s JOIN q USING (label)) SELECT row, label FROM n WHERE i <= quota""")
def stratified_context(spark, sf_dir):
    """500 of all rows, evenly by class."""
    return splits.stratified_context(relabelled(spark, sf_dir, MOST_ERRORS, "click"), "label", "row", 500).select("row", "label")


@query("l13_contingency", f"WITH {ROWS} SELECT label, machine, count(*)::BIGINT AS n FROM r GROUP BY ALL")
def contingency(spark, sf_dir):
    """Rows by class and machine."""
    return splits.contingency(rows(spark, sf_dir), "label", "machine")


@query("l13_mutual_information", f"WITH {ROWS}, c AS (SELECT label, machine, count(*)::DOUBLE AS n FROM r GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER () AS p FROM c), q AS (SELECT *, sum(p) OVER (PARTITION BY label) AS a, sum(p) OVER (PARTITION BY machine) AS b FROM p), h AS (SELECT (SELECT sum(-x * ln(x)) FROM (SELECT sum(p) AS x FROM p GROUP BY label)) + (SELECT sum(-x * ln(x)) FROM (SELECT sum(p) AS x FROM p GROUP BY machine)) AS h) SELECT round(2 * sum(p * ln(p / (a * b))) / max(h), 6) AS nmi FROM q, h")
def mutual_information(spark, sf_dir):
    """Mutual information of class and machine."""
    return rounded(splits.mutual_information(splits.contingency(rows(spark, sf_dir), "label", "machine"), "label", "machine"), "nmi")


ERROR_ABOVE = "label = 'error' and machine >= 5"


@query("l15_lomo_feasible", f"WITH {relabelled_sql(ERROR_ABOVE, 'view')}, p AS (SELECT DISTINCT machine, label FROM s), m AS (SELECT count(DISTINCT machine) AS machines FROM p), t AS (SELECT label FROM p, m GROUP BY label, machines HAVING count(*) = machines) SELECT machines::BIGINT AS machines, list_sort(list(label)) AS shared, count(*) FILTER (label <> 'view')::BIGINT AS shared_faults, machines >= 2 AND count(*) FILTER (label <> 'view') >= 1 AS feasible FROM t, m GROUP BY machines")
def lomo_feasible(spark, sf_dir):
    """Whether leaving one machine out makes sense, over all rows."""
    return splits.lomo_feasible(relabelled(spark, sf_dir, ERROR_ABOVE, "view"), "machine", "label", "view")


@query("s9_missing_fraction", "WITH t AS (SELECT user_id AS machine, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS load FROM events) SELECT machine, count(*)::BIGINT AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS hours, round(avg((load IS NULL OR isnan(load))::INT), 6) AS missing FROM t GROUP BY machine")
def missing_fraction(spark, sf_dir):
    """Span and missing share of each machine's telemetry."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("load"))
    gone = (F.col("load").isNull() | F.isnan("load")).cast("double")
    hours = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9
    return e.groupBy("machine").agg(F.count(F.lit(1)).alias("n"), r(hours).alias("hours"), r(F.avg(gone)).alias("missing"))


@query("j1_j2_channel_merge", "WITH b AS (SELECT user_id AS machine, CASE WHEN user_id % 3 = 0 THEN 'current' WHEN user_id % 3 = 2 THEN 'vibration' WHEN event_type IN ('view', 'purchase') THEN 'vibration' ELSE 'current' END AS channel FROM events), v AS (SELECT machine, count(*) AS n FROM b WHERE channel = 'vibration' GROUP BY 1), c AS (SELECT machine, count(*) AS n FROM b WHERE channel = 'current' GROUP BY 1) SELECT coalesce(v.machine, c.machine) AS machine, v.n::BIGINT AS vibration, c.n::BIGINT AS current, least(v.n, c.n)::BIGINT AS paired FROM v FULL JOIN c ON v.machine = c.machine")
def channel_merge(spark, sf_dir):
    """Bursts of two channels by key, and how many pair up; every event is a burst, and two machines of three lack a channel."""
    machine, kind = F.col("user_id"), F.col("event_type")
    channel = F.when(machine % 3 == 0, "current").when(machine % 3 == 2, "vibration").when(kind.isin("view", "purchase"), "vibration").otherwise("current")
    e = table(spark, sf_dir, "events").select(machine.alias("machine"), channel.alias("channel"))
    count = lambda name: e.where(F.col("channel") == name).groupBy("machine").agg(F.count(F.lit(1)).alias(name))
    return count("vibration").join(count("current"), "machine", "full_outer").withColumn("paired", F.least("vibration", "current"))


CHANNELS = "SELECT user_id AS machine, CASE WHEN user_id % 3 = 0 THEN 'current' WHEN user_id % 3 = 2 THEN 'vibration' WHEN event_type IN ('view', 'purchase') THEN 'vibration' ELSE 'current' END AS channel, ts, event_id, value FROM events"
BURSTS = f"b AS ({CHANNELS}), n AS (SELECT *, row_number() OVER (PARTITION BY machine, channel ORDER BY ts, event_id) - 1 AS burst FROM b), v AS (SELECT * FROM n WHERE channel = 'vibration'), c AS (SELECT * FROM n WHERE channel = 'current')"


def bursts(spark, sf_dir):
    """Every event as a burst of one of two channels; two machines of three lack one."""
    machine, kind = F.col("user_id"), F.col("event_type")
    channel = F.when(machine % 3 == 0, "current").when(machine % 3 == 2, "vibration").when(kind.isin("view", "purchase"), "vibration").otherwise("current")
    e = table(spark, sf_dir, "events").select(machine.alias("machine"), channel.alias("channel"), "ts", "event_id", F.col("value").alias("wave"))
    e = e.withColumn("burst", F.row_number().over(Window.partitionBy("machine", "channel").orderBy("ts", "event_id")) - 1)
    return [e.where(F.col("channel") == c).select("machine", "burst", "wave") for c in ("vibration", "current")]


@query("j1_channel_union", f"WITH {BURSTS} SELECT coalesce(v.machine, c.machine) AS machine, coalesce(v.burst, c.burst)::INT AS burst, v.value AS vibration, NULL::DOUBLE AS current FROM v FULL JOIN c ON v.machine = c.machine AND v.burst = c.burst")
def channel_union(spark, sf_dir):
    """Bursts of either channel by key, unpaired."""
    return readers.paired_channels(*bursts(spark, sf_dir), key=["machine"])


@query("j2_channel_pairs", f"WITH {BURSTS}, k AS (SELECT machine FROM v INTERSECT SELECT machine FROM c) SELECT coalesce(v.machine, c.machine) AS machine, coalesce(v.burst, c.burst)::INT AS burst, v.value AS vibration, c.value AS current FROM v FULL JOIN c ON v.machine = c.machine AND v.burst = c.burst WHERE coalesce(v.machine, c.machine) NOT IN (SELECT machine FROM k) OR (v.machine IS NOT NULL AND c.machine IS NOT NULL)")
def channel_pairs(spark, sf_dir):
    """Bursts paired by number where a machine has both channels, all of them where it has one."""
    return readers.paired_channels(*bursts(spark, sf_dir), pair=True, key=["machine"])


@query("j11_model_pairs","WITH m AS (SELECT DISTINCT event_type AS m FROM events) SELECT a.m AS first, b.m AS second FROM m a JOIN m b ON a.m < b.m")
def model_pairs(spark, sf_dir):
    """Unordered pairs of models; there are as many as models, which are few."""
    m = table(spark, sf_dir, "events").select(F.col("event_type").alias("m")).distinct()
    return m.select(F.col("m").alias("first")).join(F.broadcast(m.select(F.col("m").alias("second"))), F.col("first") < F.col("second"))
