"""Queries on point clouds, losses, metrics and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtlake.functions import codes
from evtlake.operators import distributions as dist
from evtlake.operators import evaluation as ev
from evtlake.operators import labels, losses, points, report
from evtlake.surrogate import views as v
from evtlake.surrogate.data import CODED, RAW
from evtlake.surrogate.registry import query, r, rounded

TOKENS, NEIGHBOURS = 8, 4
FEATURES = ("c_total", "c_500ns", "t_last")

# --- point clouds -------------------------------------------------------------------

GAP = "({a}.x-{b}.x)*({a}.x-{b}.x)+({a}.y-{b}.y)*({a}.y-{b}.y)+({a}.z-{b}.z)*({a}.z-{b}.z)+({a}.t-{b}.t)*({a}.t-{b}.t)"


def cloud_sql(source: str, tokens: int) -> dict[str, str]:
    """Farthest-point picks of the clouds of a view."""
    return {
        "sz": f"SELECT group_id, count(*) AS n FROM {source} GROUP BY 1",
        "lg": f"SELECT {source}.* FROM {source} JOIN sz USING (group_id) WHERE n > {tokens}",
        "st": (
            "SELECT group_id, pos, x, y, z, t, CAST('inf' AS DOUBLE) AS d, 0 AS step, CAST(0 AS BIGINT) AS pick FROM lg UNION ALL "
            "SELECT group_id, pos, x, y, z, t, d, step+1, CAST(first_value(pos) OVER (PARTITION BY group_id ORDER BY d DESC, pos) AS BIGINT) FROM "
            "(SELECT s.group_id, s.pos, s.x, s.y, s.z, s.t, least(s.d, " + GAP.format(a="s", b="c") + ") AS d, s.step "
            f"FROM st s JOIN lg c ON c.group_id = s.group_id AND c.pos = s.pick WHERE s.step < {tokens - 1}) q"),
        "pk": "SELECT DISTINCT group_id, CAST(step AS BIGINT) AS token_no, pick AS pos FROM st",
    }


def near_sql(source: str, tokens: int, neighbours: int) -> dict[str, str]:
    """The same with nearest neighbours and pooled features."""
    return {
        **cloud_sql(source, tokens),
        "nn": ("SELECT group_id, token_no, rn-1 AS rank, pos, d2 FROM (SELECT k.group_id, k.token_no, p.pos, "
               + GAP.format(a="p", b="c") + " AS d2, row_number() OVER (PARTITION BY k.group_id, k.token_no ORDER BY "
               + GAP.format(a="p", b="c") + ", p.pos) AS rn FROM pk k JOIN lg c ON c.group_id=k.group_id AND c.pos=k.pos "
               f"JOIN lg p ON p.group_id=k.group_id) WHERE rn <= {neighbours}"),
        "po": ("SELECT nn.group_id, nn.token_no, max(c_total) AS f0, max(c_500ns) AS f1, max(t_last) AS f2 FROM nn JOIN lg "
               "ON lg.group_id = nn.group_id AND lg.pos = nn.pos GROUP BY 1,2"),
    }


CLOUD, NEAR = cloud_sql("gp", TOKENS), near_sql("gp", TOKENS, NEIGHBOURS)
#: Clouds of suppliers: more tokens, and chunks small enough that a cloud spreads over several rows.
WIDE_TOKENS, WIDE_NEIGHBOURS, WIDE_CHUNK = 196, 8, 256


def _clouds(spark, sf):
    return points.clouds(v.group_points(spark, sf), "group_id", FEATURES)


@query(v.sql(f"SELECT group_id, token_no, pos FROM pk UNION ALL SELECT group_id, pos, pos FROM gp JOIN sz USING (group_id) WHERE n <= {TOKENS}",
             "gp", **CLOUD))
def farthest_points(spark, sf):
    return rounded(points.farthest_points(_clouds(spark, sf), "group_id", TOKENS))


@query(v.sql("SELECT group_id, token_no, rank, pos, round(d2,4) AS d2 FROM nn", "gp", **NEAR))
def knn(spark, sf):
    return rounded(points.knn(_clouds(spark, sf), "group_id", TOKENS, NEIGHBOURS), 4)


@query(v.sql("SELECT group_id, token_no, round(f0,4) AS f0, round(f1,4) AS f1, round(f2,4) AS f2 FROM po", "gp", **NEAR))
def neighbour_max_pool(spark, sf):
    pooled = points.neighbour_max_pool(_clouds(spark, sf), "group_id", TOKENS, NEIGHBOURS)
    return rounded(pooled.select("group_id", "token_no", *[F.col("pooled")[i].alias(f"f{i}") for i in range(3)]), 4)


@query(v.sql(
    "SELECT group_id, token_no, true AS valid, pos, round(f0,4) AS f0, round(f1,4) AS f1, round(f2,4) AS f2 FROM po JOIN pk USING (group_id, token_no) "
    f"UNION ALL SELECT group_id, pos, true, pos, round(c_total,4), round(c_500ns,4), round(t_last,4) FROM gp JOIN sz USING (group_id) WHERE n <= {TOKENS} "
    f"UNION ALL SELECT group_id, i, false, NULL, 0, 0, 0 FROM sz JOIN g ON i >= n WHERE n < {TOKENS}", "gp", **NEAR,
    g=f"SELECT unnest(generate_series(0,{TOKENS - 1})) AS i"))
def tokenize_events(spark, sf):
    tokens = points.tokenize_events(_clouds(spark, sf), "group_id", TOKENS, NEIGHBOURS, len(FEATURES))
    return rounded(tokens.select(
        "group_id", "token_no", "valid", "pos", *[F.col("features")[i].alias(f"f{i}") for i in range(3)]), 4)


def _wide_clouds(spark, sf, chunk):
    return points.clouds(v.supplier_points(spark, sf), "group_id", FEATURES, chunk=chunk)


@query(v.sql("SELECT group_id, token_no, rank, pos, round(d2,4) AS d2 FROM nn", "sp", **near_sql("sp", WIDE_TOKENS, WIDE_NEIGHBOURS)))
def knn_wide(spark, sf):
    """Large clouds, each inside one task."""
    return rounded(points.knn(_wide_clouds(spark, sf, points.CHUNK), "group_id", WIDE_TOKENS, WIDE_NEIGHBOURS), 4)


@query(v.sql("SELECT group_id, token_no, true AS valid, pos, round(f0,4) AS f0, round(f1,4) AS f1, round(f2,4) AS f2 FROM po JOIN pk USING (group_id, token_no) "
             f"UNION ALL SELECT group_id, pos, true, pos, round(c_total,4), round(c_500ns,4), round(t_last,4) FROM sp JOIN sz USING (group_id) WHERE n <= {WIDE_TOKENS}",
             "sp", **near_sql("sp", WIDE_TOKENS, WIDE_NEIGHBOURS)))
def tokenize_spread(spark, sf):
    """The same clouds, spread over several rows each."""
    tokens = points.tokenize_events(_wide_clouds(spark, sf, WIDE_CHUNK), "group_id", WIDE_TOKENS, WIDE_NEIGHBOURS, len(FEATURES))
    return rounded(tokens.where("valid").select("group_id", "token_no", "valid", "pos", *[F.col("features")[i].alias(f"f{i}") for i in range(3)]), 4)


LINEAR = {"num_sensors": 0.05, "total_charge": 1e-6, "mc_primary_dir_z": -0.5}


@query(v.sql(
    "SELECT event_id, round(0.05e0*num_sensors+1e-6*total_charge-0.5e0*mc_primary_dir_z,5) AS score, "
    "round(log10(greatest(mc_primary_energy,1e-6)),5) AS true_log_energy FROM ec", "ec"))
def score_events(spark, sf):
    events = v.events_with_stats(spark, sf).select(
        "event_id", *LINEAR, F.log10(F.greatest("mc_primary_energy", F.lit(1e-6))).alias("true_log_energy"))

    def predict(frame):
        frame["score"] = sum(w * frame[c] for c, w in LINEAR.items())
        return frame[["event_id", "score", "true_log_energy"]]

    scored = points.score_events(events, predict, "event_id long, score double, true_log_energy double")
    return rounded(scored, 5)


TOKEN_VALUES = (
    "SELECT group_id, f0 FROM po UNION ALL SELECT group_id, c_total FROM gp JOIN sz USING (group_id) WHERE n <= " + str(TOKENS))
SCORED_TOKENS = ("SELECT t.group_id, 3+sum(f0)/count(*)*5e-5 AS pred, l.true_log FROM tv t JOIN "
                 "(SELECT group_id, log10(greatest(avg(mc_primary_energy),1e-6)) AS true_log FROM ev GROUP BY 1) l USING (group_id) GROUP BY 1, 3")


@query(v.sql("SELECT round(avg(abs(pred-true_log)),5) AS mae, round(median(abs(pred-true_log)),5) AS median_ae, "
             "round(sqrt(avg((pred-true_log)*(pred-true_log))),5) AS rms, round(avg(pred-true_log),5) AS bias FROM s", "gp", **NEAR,
             tv=TOKEN_VALUES, s=SCORED_TOKENS))
def score_tokens(spark, sf):
    """Tokens with their labels go through a predictor, and its predictions through the energy report."""
    tokens = points.tokenize_events(_clouds(spark, sf), "group_id", TOKENS, NEIGHBOURS, len(FEATURES))
    truth = v.events(spark, sf).groupBy("group_id").agg(F.log10(F.greatest(F.avg("mc_primary_energy"), F.lit(1e-6))).alias("true_log"))

    rows = points.token_rows(tokens, truth, "group_id").select(
        "group_id", "true_log", F.flatten("features").alias("features"), F.transform("valid", lambda v: v.cast("double")).alias("valid"))

    def load():
        def predict(features, valid):
            return 3 + (features[:, :, 0] * valid).sum(axis=1) / valid.sum(axis=1) * 5e-5
        return predict

    scored = points.score_batches(rows, load, {"features": (TOKENS, len(FEATURES)), "valid": (TOKENS,)}, "double", out="pred")
    return rounded(report.evaluate("energy_reco", scored, "pred", "true_log")["summary"], 5)


# --- losses and validation, per directory -------------------------------------------------



def direction():
    """Predicted and true direction columns."""
    return [F.col(f"pred_{a}") for a in "xyz"], [F.col(c) for c in codes.TRUTH_COLUMNS[1:]]


def vertex():
    """Predicted and true vertex: directions in units of 500 m."""
    return tuple([c * 500 for c in side] for side in direction())


SIG = "(greatest(raw_sigma,0)+ln(1+exp(-abs(raw_sigma)))+1e-6)"
RES = "(pred_log_energy-true_log_energy)"
NORM = "sqrt(pred_x*pred_x+pred_y*pred_y+pred_z*pred_z)"
TNORM = "sqrt(mc_primary_dir_x*mc_primary_dir_x+mc_primary_dir_y*mc_primary_dir_y+mc_primary_dir_z*mc_primary_dir_z)"
DOT = "(pred_x*mc_primary_dir_x+pred_y*mc_primary_dir_y+pred_z*mc_primary_dir_z)"
ANG = f"acos(least(greatest({DOT}/{NORM}/{TNORM},-1+1e-7),1-1e-7))"
D2 = "(" + "+".join(f"(pred_{a}-mc_primary_dir_{a})*(pred_{a}-mc_primary_dir_{a})" for a in "xyz") + ")"
DIST = f"(500e0*sqrt({D2}))"
LAB = f"CAST(CASE {RAW} WHEN -1 THEN 0 WHEN 6 THEN -1 ELSE CASE WHEN mc_event_morphology IN ('0T1C','0TnC','1T1C','1TnC') THEN 1 ELSE 0 END END AS BIGINT)"
BINARY = {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 1, 6: -1, 7: 0}


def by_dir(measures: str) -> str:
    return v.sql(f"SELECT dir, {measures} FROM pr GROUP BY dir", "pr")


def per_dir(spark, sf, *measures):
    return rounded(v.predictions(spark, sf).groupBy("dir").agg(*measures))


def classified(spark, sf):
    raw = labels.raw_index(F.col(codes.MORPHOLOGY_COLUMN), BINARY, "flat")
    return v.predictions(spark, sf).withColumn("morphology_raw", raw).withColumn(
        "label", labels.class_label(F.col("morphology_raw"), BINARY, "flat"))


@query(by_dir(f"round(avg(ln({SIG})+{RES}*{RES}/(2*{SIG}*{SIG})),6) AS loss"))
def gaussian_nll_1d(spark, sf):
    loss = losses.gaussian_nll([F.col("pred_log_energy")], [F.col("true_log_energy")], F.col("raw_sigma"))
    return per_dir(spark, sf, loss.alias("loss"))


@query(by_dir(f"round(avg(3*ln({SIG})+{D2}/(2*{SIG}*{SIG})),6) AS loss"))
def gaussian_nll_3d(spark, sf):
    return per_dir(spark, sf, losses.gaussian_nll(*direction(), F.col("raw_sigma")).alias("loss"))


@query(by_dir(
    f"round(-avg({DOT}-{NORM}+ln(({NORM}+1e-8)/(1-exp(-2*{NORM})+2e-8))),6) AS loss, "
    f"round(-avg({DOT}/{NORM}-1+ln((1+1e-8)/(1-exp(-2e0)+2e-8))),6) AS loss_normalised"))
def vmf_loss(spark, sf):
    return per_dir(spark, sf, losses.vmf_loss(*direction()).alias("loss"),
                   losses.vmf_loss(*direction(), normalise_first=True).alias("loss_normalised"))


@query(by_dir(f"round(avg({ANG}),5) AS mean_angle, round(sum({ANG}),2) AS sum_angle"))
def angular_distance(spark, sf):
    df = v.predictions(spark, sf).groupBy("dir").agg(
        losses.angular_distance(*direction()).alias("mean_angle"),
        losses.angular_distance(*direction(), "sum").alias("sum_angle"))
    return rounded(df, 5, sum_angle=2)


@query(by_dir(f"round(avg({RES}*{RES}),6) AS loss"))
def mse_1d(spark, sf):
    return per_dir(spark, sf, losses.mse([F.col("pred_log_energy")], [F.col("true_log_energy")]).alias("loss"))


@query(by_dir(f"round(avg(250000e0*{D2}/3),2) AS loss"))
def mse_vertex(spark, sf):
    return rounded(v.predictions(spark, sf).groupBy("dir").agg(losses.mse(*vertex()).alias("loss")), 2)


LSE = "(greatest(logit_0,logit_1)+ln(exp(logit_0-greatest(logit_0,logit_1))+exp(logit_1-greatest(logit_0,logit_1))))"


@query(v.sql(f"SELECT dir, round(avg({LSE}-CASE WHEN label=0 THEN logit_0 ELSE logit_1 END),6) AS loss FROM c WHERE label <> -1 GROUP BY dir",
             "pr", c=f"SELECT *, {LAB} AS label FROM pr"))
def cross_entropy(spark, sf):
    return rounded(classified(spark, sf).groupBy("dir").agg(
        losses.cross_entropy(F.col("logits"), F.col("label")).alias("loss")))


@query(by_dir(f"round(avg(abs({RES})),6) AS mae, round(avg({RES}*{RES}),6) AS mse, round(avg({SIG}),6) AS mean_sigma"))
def energy_validation(spark, sf):
    return per_dir(spark, sf, *losses.energy_validation(
        F.col("pred_log_energy"), F.col("true_log_energy"), F.col("raw_sigma")))


@query(by_dir(f"round(avg({DIST}),4) AS mean_distance"))
def vertex_validation(spark, sf):
    return rounded(v.predictions(spark, sf).groupBy("dir").agg(
        losses.mean_distance(*vertex()).alias("mean_distance")), 4)


@query(by_dir(f"round(quantile_disc(degrees({ANG}),0.5),4) AS median_angular_error_deg"))
def angular_validation(spark, sf):
    return rounded(losses.angular_validation(v.predictions(spark, sf), *direction(), ["dir"]), 4)


@query(v.sql("SELECT dir, round(avg(CASE WHEN (logit_1 > logit_0) = (label = 1) THEN 1e0 ELSE 0e0 END),6) AS accuracy "
             "FROM c WHERE label >= 0 GROUP BY dir", "pr", c=f"SELECT *, {LAB} AS label FROM pr"))
def class_validation(spark, sf):
    return rounded(classified(spark, sf).groupBy("dir").agg(
        losses.accuracy(F.col("logits"), F.col("label")).alias("accuracy")))


# --- classification ---------------------------------------------------------------------------

PREDICTED = (f"SELECT *, CAST(CASE WHEN logit_1 > logit_0 THEN 1 ELSE 0 END AS BIGINT) AS predicted, 1/(1+exp(logit_1-logit_0)) AS p0, "
             f"1/(1+exp(logit_0-logit_1)) AS p1 FROM (SELECT *, {LAB} AS label, {RAW} AS morphology_raw FROM pr) WHERE label <> -1")


def predicted(spark, sf):
    return ev.predict_class(classified(spark, sf), F.col("logits"), "label")


@query(v.sql("SELECT event_id, predicted, round(p0,6) AS p0, round(p1,6) AS p1 FROM c", "pr", c=PREDICTED))
def predict_class(spark, sf):
    return rounded(predicted(spark, sf).select(
        "event_id", "predicted", F.col("probs")[0].alias("p0"), F.col("probs")[1].alias("p1")))


SEVEN = ", ".join(f"(event_id*{3 + 2 * i}) % {17 + i}/5e0" for i in range(7))


@query(v.sql("SELECT label, count(*) AS n, CAST(sum(k) AS BIGINT) AS predicted_sum, round(avg(exp(list_max(l)-m)),6) AS p_top, "
             "round(avg(m-l[label+1]),6) AS loss FROM (SELECT *, list_position(l, list_max(l))-1 AS k, "
             "list_max(l)+ln(list_sum(list_transform(l, lambda x: exp(x-list_max(l))))) AS m FROM q) GROUP BY label", "ev",
             q=f"SELECT [{SEVEN}] AS l, event_id % 7 AS label FROM ev"))
def seven_classes(spark, sf):
    """Predictions and cross entropy of seven classes."""
    rows = v.events(spark, sf).select(F.expr(f"array({SEVEN})").alias("logits"), F.expr("cast(event_id % 7 as int)").alias("label"))
    predicted = ev.predict_class(rows, F.col("logits"), "label")
    return rounded(predicted.groupBy("label").agg(
        F.count("*").alias("n"), F.sum("predicted").alias("predicted_sum"), F.avg(F.array_max("probs")).alias("p_top"),
        losses.cross_entropy(F.col("logits"), F.col("label")).alias("loss")))


def _cells(row: str, rows: str) -> str:
    return v.sql(
        f"SELECT {row}, predicted, coalesce(n,0) AS \"count\", round(CASE WHEN sum(coalesce(n,0)) OVER (PARTITION BY {row}) > 0 THEN "
        f"100e0*coalesce(n,0)/sum(coalesce(n,0)) OVER (PARTITION BY {row}) ELSE 0 END,6) AS percent FROM ({rows}) CROSS JOIN "
        f"(SELECT unnest([0,1]::BIGINT[]) AS predicted) LEFT JOIN (SELECT {row}, predicted, count(*) AS n FROM c GROUP BY 1,2) USING ({row}, predicted)",
        "pr", c=PREDICTED)


@query(_cells("morphology_raw", "SELECT DISTINCT morphology_raw FROM c WHERE morphology_raw >= 0"))
def confusion_raw(spark, sf):
    return rounded(ev.confusion_raw(predicted(spark, sf), range(8), 2))


@query(_cells("label", "SELECT unnest([0,1]::BIGINT[]) AS label"))
def confusion_mapped(spark, sf):
    return rounded(ev.confusion_mapped(predicted(spark, sf), 2))


@query(v.sql("SELECT coalesce(label,-9) AS label, round(avg(CASE WHEN predicted=label THEN 1e0 ELSE 0e0 END),6) AS accuracy, "
             "count(*) AS n FROM c GROUP BY ROLLUP (label)", "pr", c=PREDICTED))
def class_accuracy(spark, sf):
    return rounded(ev.class_accuracy(predicted(spark, sf)).na.fill(-9, ["label"]))


ROC = {
    "c": PREDICTED,
    "s": "SELECT 0::BIGINT AS class, round(p0,9) AS threshold, label = 0 AS hit FROM c UNION ALL SELECT 1::BIGINT, round(p1,9), label = 1 FROM c",
    "g": "SELECT class, threshold, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS q FROM s GROUP BY 1,2",
    "k": "SELECT class, threshold, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY class) AS np, "
         "sum(q) OVER (PARTITION BY class) AS nq FROM g WINDOW w AS (PARTITION BY class ORDER BY threshold DESC)",
}


def scored(spark, sf):
    """Probabilities to nine digits, so that both engines see the same ties."""
    return predicted(spark, sf).withColumn("probs", F.transform("probs", lambda p: F.round(p, 9)))


@query(v.sql("SELECT class, threshold, round(fp/nq::DOUBLE,6) AS fpr, round(tp/np::DOUBLE,6) AS tpr FROM k "
             "UNION ALL SELECT DISTINCT class, NULL, 0, 0 FROM k", "pr", **ROC))
def roc_curve(spark, sf):
    return rounded(ev.roc_curve(scored(spark, sf), "probs", "label", 2), 6, threshold=9)


@query(v.sql("SELECT class, round(sum((fp-fp0)*(tp+tp0)/2e0)/(max(np)*max(nq)),6) AS auc FROM (SELECT *, "
             "lag(fp,1,0) OVER w AS fp0, lag(tp,1,0) OVER w AS tp0 FROM k WINDOW w AS (PARTITION BY class ORDER BY threshold DESC)) GROUP BY 1",
             "pr", **ROC))
def roc_auc(spark, sf):
    return rounded(ev.roc_auc(scored(spark, sf), "probs", "label", 2))


# --- summaries ----------------------------------------------------------------------------------

ANGULAR = (f"SELECT *, degrees({ANG}) AS error_deg, {NORM} AS kappa, CASE WHEN abs(mc_primary_dir_z) <= 1 THEN mc_primary_dir_z END AS tz, "
           f"pred_z/{NORM} AS pz FROM pr")


def angular(spark, sf):
    return ev.angular_errors(v.predictions(spark, sf), *direction())


def vertices(spark, sf):
    return ev.vertex_errors(v.predictions(spark, sf), *vertex(), F.col("raw_sigma"))[0]


def energies(spark, sf, sigma=True):
    return ev.energy_errors(v.predictions(spark, sf), F.col("pred_log_energy"), F.col("true_log_energy"),
                            F.col("raw_sigma") if sigma else None)[0]


@query(v.sql("SELECT round(median(error_deg),4) AS median_deg, round(avg(error_deg),4) AS mean_deg, round(stddev_pop(error_deg),4) AS std_deg, "
             "round(min(kappa),4) AS min_kappa, round(avg(kappa),4) AS mean_kappa, round(max(kappa),4) AS max_kappa FROM a", "pr", a=ANGULAR))
def angular_summary(spark, sf):
    return rounded(ev.angular_summary(angular(spark, sf)), 4)


@query(v.sql(
    f"SELECT round(median(d),4) AS median_distance, round(avg(d),4) AS mean_distance, round(stddev_pop(d),4) AS std_distance, "
    + ", ".join(f"round(avg(p{a}),3) AS mean_pull_{a}, round(stddev_pop(p{a}),3) AS std_pull_{a}" for a in "xyz")
    + f" FROM (SELECT {DIST} AS d, " + ", ".join(f"500*(mc_primary_dir_{a}-pred_{a})/{SIG} AS p{a}" for a in "xyz") + " FROM pr)", "pr"))
def vertex_summary(spark, sf):
    out = ev.vertex_summary(vertices(spark, sf))
    return rounded(out, 3, **{c: 4 for c in out.columns if c.endswith("distance")})


ENERGY = (f"round(avg(abs({RES})),6) AS mae, round(median(abs({RES})),6) AS median_ae, round(sqrt(avg({RES}*{RES})),6) AS rms, "
          f"round(avg({RES}),6) AS bias")


@query(v.sql(f"SELECT {ENERGY}, round(avg({SIG}),6) AS mean_sigma, round(avg(-{RES}/{SIG}),6) AS pull_mean, "
             f"round(stddev_pop(-{RES}/{SIG}),6) AS pull_std FROM pr", "pr"))
def energy_summary_gaussian(spark, sf):
    return rounded(ev.energy_summary(energies(spark, sf)))


@query(v.sql(f"SELECT dir, {ENERGY} FROM pr GROUP BY dir", "pr"))
def energy_summary_mse(spark, sf):
    return rounded(ev.energy_summary(energies(spark, sf, sigma=False), ["dir"]))


# --- histograms -------------------------------------------------------------------------------------


def edges(source: str, column: str, bins: int, low: str | None = None, high: str | None = None) -> str:
    """Edge table (i, e0, e1, last) of even bins over a column's range or fixed limits."""
    lo = low or f"(SELECT CASE WHEN min({column})=max({column}) THEN min({column})-0.5e0 ELSE min({column}) END FROM {source})"
    hi = high or f"(SELECT CASE WHEN min({column})=max({column}) THEN max({column})+0.5e0 ELSE max({column}) END FROM {source})"
    return (f"SELECT i, lo+i*((hi-lo)/{bins}e0) AS e0, CASE WHEN i={bins - 1} THEN hi ELSE lo+(i+1)*((hi-lo)/{bins}e0) END AS e1, "
            f"i={bins - 1} AS last FROM (SELECT {lo} AS lo, {hi} AS hi), (SELECT unnest(generate_series(0,{bins - 1})) AS i)")


def within(column: str, e: str) -> str:
    return f"{column} >= {e}.e0 AND ({column} < {e}.e1 OR ({e}.last AND {column} = {e}.e1))"


def counts_1d(source: str, column: str, e: str) -> str:
    return (f"SELECT {e}.i, any_value({e}.e0) AS e0, any_value({e}.e1) AS e1, count(s.{column}) AS n FROM {e} LEFT JOIN {source} s "
            f"ON {within('s.' + column, e)} GROUP BY {e}.i")


@query(v.sql(
    "SELECT series, i AS bin, n AS \"count\", round(e0,5) AS low, round(e1,5) AS high, round(n/(sum(n) OVER (PARTITION BY series)*(e1-e0)),5) AS density "
    "FROM (SELECT 'true' AS series, * FROM ht UNION ALL SELECT 'pred', * FROM hp)", "pr", a=ANGULAR,
    et=edges("a", "tz", 50), ep=edges("a", "pz", 50), ht=counts_1d("a", "tz", "et"), hp=counts_1d("a", "pz", "ep")))
def zenith_histograms(spark, sf):
    errors = angular(spark, sf).withColumn("true_cos_zenith", F.col("mc_primary_dir_z"))
    return rounded(dist.zenith_histograms(errors), 5)


@query(v.sql(
    "SELECT 'residual' AS series, i AS bin, n AS \"count\", round(e0,6) AS low, round(e1,6) AS high FROM hr UNION ALL "
    "SELECT 'distance', i, n, round(e0,6), round(e1,6) FROM hd", "pr", a=f"SELECT round({RES},2) AS res, {DIST} AS d FROM pr",
    er=edges("a", "res", 50), ed=edges("a", "d", 50, "0e0", "1000e0"), hr=counts_1d("a", "res", "er"), hd=counts_1d("a", "d", "ed")))
def histogram_1d(spark, sf):
    """Residuals over their own range, distances over a fixed one."""
    residuals = energies(spark, sf).withColumn("residual", F.round("residual", 2))
    parts = [dist.histogram_1d(residuals, "residual").withColumn("series", F.lit("residual")),
             dist.histogram_1d(vertices(spark, sf), "distance", limits=(0, 1000)).withColumn("series", F.lit("distance"))]
    return rounded(parts[0].unionByName(parts[1]))


@query(v.sql(
    "SELECT i AS point, round(lo+i*(hi-lo)/199e0,5) AS x, round(sum(exp(-0.5e0*((lo+i*(hi-lo)/199e0-res)/h)*((lo+i*(hi-lo)/199e0-res)/h)))"
    "/(max(n)*max(h)*sqrt(2*pi())),5) AS density FROM a, f, (SELECT unnest(generate_series(0,199)) AS i) GROUP BY i, lo, hi", "pr",
    a=f"SELECT {RES} AS res FROM pr",
    f="SELECT min(res) AS lo, max(res) AS hi, count(*) AS n, stddev_samp(res)*pow(count(*),-0.2e0) AS h FROM a"))
def kde_1d(spark, sf):
    return rounded(dist.kde_1d(energies(spark, sf), "residual"), 5)


def cells_2d(source: str, x: str, y: str) -> str:
    return (f"SELECT ex.i AS xb, ey.i AS yb, coalesce(c.n,0) AS n, ex.e0 AS x0, ex.e1 AS x1, ey.e0 AS y0, ey.e1 AS y1 FROM ex CROSS JOIN ey LEFT JOIN "
            f"(SELECT ex.i AS xi, ey.i AS yi, count(*) AS n FROM {source} s JOIN ex ON {within('s.' + x, 'ex')} JOIN ey ON {within('s.' + y, 'ey')} "
            "GROUP BY 1,2) c ON c.xi = ex.i AND c.yi = ey.i")


SHARE = "round(CASE WHEN sum(n) OVER (PARTITION BY xb) > 0 THEN n/(sum(n) OVER (PARTITION BY xb))::DOUBLE ELSE 0 END,6) AS share"


@query(v.sql(f"SELECT xb, yb, n AS \"count\", {SHARE} FROM h", "pr", a=ANGULAR,
             ex=edges("a", "true_log_energy", 20), ey=edges("a", "error_deg", 50), h=cells_2d("a", "true_log_energy", "error_deg")))
def histogram_2d_colnorm(spark, sf):
    return rounded(dist.histogram_2d_colnorm(angular(spark, sf), "true_log_energy", "error_deg", (20, 50)))


@query(v.sql("SELECT xb, yb, n AS \"count\", round(n/((sum(n) OVER ())*(x1-x0)*(y1-y0)),6) AS density FROM h "
             "QUALIFY n/((sum(n) OVER ())*(x1-x0)*(y1-y0)) >= 1e-5", "pr",
             a=f"SELECT true_log_energy AS e, {DIST} AS d FROM pr", ex=edges("a", "e", 50, "4e0", "7e0"),
             ey=edges("a", "d", 50, "0e0", "1000e0"), h=cells_2d("a", "e", "d")))
def histogram_2d_density(spark, sf):
    return rounded(dist.histogram_2d_density(vertices(spark, sf), "true_log_energy", "distance", (4, 7), (0, 1000)))


@query(v.sql(f"SELECT 'angular_error' AS map, xb, yb, n AS \"count\", {SHARE} FROM h UNION ALL SELECT 'cos_zenith', xb, yb, n, {SHARE} FROM h2", "pr",
             a=ANGULAR, ex=edges("a", "error_deg", 50), ey=edges("a", "kappa", 50), h=cells_2d("a", "error_deg", "kappa"),
             ez=edges("a", "pz", 50), h2=cells_2d("a", "pz", "kappa").replace("ex.", "ez.").replace("ex ", "ez ")))
def kappa_maps(spark, sf):
    return rounded(dist.kappa_maps(angular(spark, sf)))


def _calibration(limit: str) -> dict[str, str]:
    return {"ex": edges("a", "s", 50, "0e0", limit), "ey": edges("a", "d", 50, "0e0", limit), "h": cells_2d("a", "s", "d")}


def _density(name: str, limit: float) -> str:
    area = (limit / 50) ** 2
    return (f"SELECT '{name}' AS task, xb, yb, n AS \"count\", round(n/((sum(n) OVER ())*{area!r}e0),6) AS density "
            f"FROM {{}} QUALIFY n/((sum(n) OVER ())*{area!r}e0) >= 1e-5")


@query(v.sql(
    _density("vertex", 1000.0).format("h") + " UNION ALL " + _density("energy", 2.0).format("h2"), "pr",
    a=f"SELECT 100e0*{SIG} AS s, {DIST} AS d, {SIG} AS es, round(abs({RES}),2) AS ed FROM pr", **_calibration("1000e0"),
    fx=edges("a", "es", 50, "0e0", "2e0"), fy=edges("a", "ed", 50, "0e0", "2e0"),
    h2=cells_2d("a", "es", "ed").replace("ex.", "fx.").replace("ex ", "fx ").replace("ey.", "fy.").replace("ey ", "fy ")))
def sigma_calibration(spark, sf):
    vertex_map = dist.sigma_calibration(vertices(spark, sf).withColumn("sigma", 100 * F.col("sigma")), "sigma", "distance", 1000.0)
    energy_map = dist.sigma_calibration(energies(spark, sf).withColumn("abs_residual", F.round("abs_residual", 2)), "sigma", "abs_residual", 2.0)
    return rounded(vertex_map.withColumn("task", F.lit("vertex")).unionByName(energy_map.withColumn("task", F.lit("energy"))))


# --- profiles ----------------------------------------------------------------------------------------


def profile(x: str, y: str, keys: str = "") -> dict[str, str]:
    k = f"{keys}, " if keys else ""
    on = f"AND g.{keys} = s.{keys}" if keys else ""
    groups = f"(SELECT DISTINCT {keys} FROM a)" if keys else "(SELECT 1 AS one)"
    gk = f"g.{keys}, " if keys else ""
    return {
        "ex": edges("a", x, 20),
        "pf": (f"SELECT {gk}ex.i AS bin, any_value((ex.e0+ex.e1)/2) AS centre, count(s.{y}) AS n, median(s.{y}) AS median, quantile_cont(s.{y},0.25) AS p25, "
               f"quantile_cont(s.{y},0.75) AS p75, sqrt(avg(s.{y}*s.{y})) AS rms FROM ex CROSS JOIN {groups} g LEFT JOIN a s ON "
               f"s.{x} >= ex.e0 AND s.{x} < ex.e1 {on} GROUP BY {gk}ex.i"),
    }


def _profile_out(digits: int, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return (f"SELECT {k}bin, n, round(centre,6) AS centre, " + ", ".join(f"round({c},{digits}) AS {c}" for c in ("median", "p25", "p75", "rms")) + " FROM pf")


@query(v.sql(_profile_out(4), "pr", a=ANGULAR, **profile("true_log_energy", "error_deg")))
def binned_profile(spark, sf):
    return rounded(dist.binned_profile(angular(spark, sf), "true_log_energy", "error_deg"), 4, centre=6)


@query(v.sql(_profile_out(6, "dir"), "pr", a=f"SELECT *, {RES} AS res FROM pr", **profile("true_log_energy", "res", "dir")))
def energy_resolution(spark, sf):
    return rounded(dist.energy_resolution(v.predictions(spark, sf), "pred_log_energy", "true_log_energy", keys=["dir"]))


@query(v.sql(_profile_out(5), "pr", a="SELECT *, (pow(10e0,pred_log_energy)-pow(10e0,true_log_energy))/pow(10e0,true_log_energy) AS fe FROM pr",
             **profile("true_log_energy", "fe")))
def fractional_energy_error(spark, sf):
    return rounded(dist.fractional_energy_error(v.predictions(spark, sf), "pred_log_energy", "true_log_energy"), 5, centre=6)


SMOOTHED = ("median", "rms")
WEIGHTS = "(SELECT j, exp(-0.5e0*j*j/2.25e0)/sum(exp(-0.5e0*j*j/2.25e0)) OVER () AS w FROM (SELECT unnest(generate_series(-6,6)) AS j))"


def _filled(c: str) -> str:
    left = f"(SELECT max(q.bin) FROM pf q WHERE q.dir=p.dir AND q.bin<=p.bin AND q.{c} IS NOT NULL)"
    right = f"(SELECT min(q.bin) FROM pf q WHERE q.dir=p.dir AND q.bin>=p.bin AND q.{c} IS NOT NULL)"
    return f"{left} AS {c}_l, {right} AS {c}_r"


@query(v.sql(
    "SELECT f.dir, f.bin, " + ", ".join(f"round(sum(w.w*s.{c}),6) AS {c}_smooth" for c in SMOOTHED) + f" FROM fi f CROSS JOIN {WEIGHTS} w "
    "JOIN fi s ON s.dir = f.dir AND s.bin = CASE WHEN f.bin+w.j < 0 THEN -1-(f.bin+w.j) WHEN f.bin+w.j > 19 THEN 39-(f.bin+w.j) ELSE f.bin+w.j END "
    "GROUP BY 1,2", "pr", a=f"SELECT dir, true_log_energy, {RES} AS res FROM pr", **profile("true_log_energy", "res", "dir"),
    fl="SELECT p.dir, p.bin, " + ", ".join(_filled(c) for c in SMOOTHED) + " FROM pf p",
    fi="SELECT f.dir, f.bin, " + ", ".join(
        f"CASE WHEN {c}_l IS NULL THEN r{c}.{c} WHEN {c}_r IS NULL OR {c}_l={c}_r THEN l{c}.{c} ELSE "
        f"l{c}.{c}+(r{c}.{c}-l{c}.{c})*(f.bin-{c}_l)/({c}_r-{c}_l)::DOUBLE END AS {c}" for c in SMOOTHED) + " FROM fl f "
       + " ".join(f"LEFT JOIN pf l{c} ON l{c}.dir=f.dir AND l{c}.bin={c}_l LEFT JOIN pf r{c} ON r{c}.dir=f.dir AND r{c}.bin={c}_r" for c in SMOOTHED)))
def smooth_profile(spark, sf):
    profile_ = dist.energy_resolution(v.predictions(spark, sf), "pred_log_energy", "true_log_energy", keys=["dir"])
    out = dist.smooth_profile(profile_, SMOOTHED, ["dir"])
    return rounded(out.select("dir", "bin", *[f"{c}_smooth" for c in SMOOTHED]))
