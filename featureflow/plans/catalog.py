"""One query per operator over the test tables. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.rules import balance_ratio, binarize, replace_rare, shift_log, zscore
from ..operators.categories import (
    categorical_test,
    category_ratios,
    category_stats,
    test_only_values,
)
from ..operators.champion import champion_gate
from ..operators.derive import derive
from ..operators.encode import assemble, category_table, fit_category_index, one_hot
from ..operators.evaluate import area_under_roc, confusion, split_metrics, split_summary
from ..operators.joins import attach_columns, attach_labels, holdout
from ..operators.models import refit, score, validate
from ..operators.moments import column_moments, combine
from ..operators.profile import Profile, profile_stacked
from ..operators.ranks import read_numbered, with_row_num
from ..operators.shapiro import shapiro_wilk
from ..operators.split import bernoulli_sample, keyed_split, named_split
from ..operators.summaries import class_rate, density, histogram, kernel_density, smooth_rate
from ..sources.champion import read_champion, write_champion
from ..sources.storage import scratch_path
from ..sources.tables import publish, read_csv, read_role, write_csv, write_predictions
from .scorer import Scorer
from .workflow import run

SEED = 1
SEEDS = (1, 2, 3, 4, 5)
LOG_SHIFTS = (0.01, 0.5, 1.0, 20.0)
LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _flags() -> dict:
    return {p: F.col("name") == p for p in ("train", "test")}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _lines(spark, folder) -> DataFrame:
    return named_split(table(spark, folder, "lineitem"), "l_orderkey", SEED)


def _events(spark, folder) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "value", F.floor(F.col("value") / 10).cast("double").alias("bucket"))
    return named_split(events, "event_id", SEED)


def _parts(spark, folder) -> DataFrame:
    return named_split(table(spark, folder, "part"), "p_partkey", SEED)


def _rule_scored(spark, folder, rule: str = "l_discount > 0.05") -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        F.expr(rule).cast("double").alias("prediction"),
    )


# Profiling


def categorical_profile(spark, folder):
    """Decimal test and distinct values of the numeric columns of three tables."""
    columns = {
        "lineitem": LINE_NUMBERS,
        "part": ["p_size", "p_retailprice"],
        "orders": ["o_totalprice"],
    }
    return _union(
        [categorical_test(table(spark, folder, t), c).select(F.lit(t).alias("table_name"), "*") for t, c in columns.items()]
    )


def balance(spark, folder):
    """Balance ratio of a label and of a mostly zero column."""
    toxic = table(spark, folder, "labels").agg(balance_ratio(F.col("toxic").cast("double")).alias("ratio"))
    large = table(spark, folder, "lineitem").agg(balance_ratio(F.greatest(F.col("l_quantity") - 46, F.lit(0.0))).alias("ratio"))
    return _union(
        [
            toxic.select(F.lit("toxic").alias("column_name"), F.round("ratio", 6).alias("ratio")),
            large.select(F.lit("over_46").alias("column_name"), F.round("ratio", 6).alias("ratio")),
        ]
    )


def category_ratio(spark, folder):
    """Frequency of each category over the most frequent one."""
    ratios = category_ratios(_events(spark, folder), ["bucket"], {"train": F.lit(True)})
    return ratios.select("value", F.col("n_train").alias("n"), "ratio")


def truncate_rare(spark, folder):
    """Rare categories replaced by their unweighted mean."""
    events = _events(spark, folder)
    stats, _ = category_stats(events, ["bucket"], {"train": F.lit(True), "test": F.lit(False)}, 0.01)
    found = stats["bucket"]
    value = F.round(replace_rare(F.col("bucket"), found.rare, found.replacement), 6)
    return events.select("event_id", "bucket", value.alias("bucket_trunc_cat"))


def binarize_column(spark, folder):
    """Positive values to one, by raw value."""
    over = F.greatest(F.col("l_quantity") - 46, F.lit(0.0))
    return (
        table(spark, folder, "lineitem")
        .select(over.alias("raw"), binarize(over).alias("binarized"))
        .groupBy("raw", "binarized")
        .agg(F.count("*").alias("n"))
    )


def category_passthrough(spark, folder):
    """A plain category: derived by the dispatcher, with its used mark."""
    parts = _parts(spark, folder)
    found = profile_stacked(parts, ["p_size"])
    used = found.usage(spark).filter("used").select(F.col("derived_name"))
    kind = used.first()["derived_name"]
    return derive(parts, found, F.col("name"), ["p_partkey", "name"]).select(
        "p_partkey", "name", F.lit(kind).alias("derived_name"), F.col(kind).alias("value")
    )


def _branches(spark, folder) -> DataFrame:
    """Columns that between them reach every decision of the profile, with a train and a test that disagree."""
    number, price = F.col("l_linenumber").cast("double"), F.col("l_extendedprice")
    steep = F.pow(F.lit(2.0), number) + 0.25
    return _lines(spark, folder).select(
        "name",
        F.greatest(F.col("l_quantity") - 46, F.lit(0.0)).alias("over"),
        F.floor(F.pow(price / 10_000, F.lit(2.0)) / 4).cast("double").alias("step"),
        F.col("l_quantity").alias("quantity"),
        (number + 0.25).alias("place"),
        steep.alias("doubled"),
        price.alias("price"),
        F.when(F.col("name") == "train", number + 0.25).otherwise(steep).alias("mixed"),
    )


def derive_branches(spark, folder):
    """Every branch of the dispatcher: the decision for each column and what its derived values add up to."""
    config, rows = Config(log_eps=1.0, category_trunc_threshold=0.35), _branches(spark, folder)
    found = profile_stacked(rows, rows.columns[1:], config)
    derived = derive(rows, found, F.col("name"), ["name"], config)
    names = [(p.column_name, n) for p in found.columns for n in p.outputs()]
    stats = {"n": F.count, "mean": F.avg, "low": F.min, "high": F.max}
    wide = derived.groupBy("name").agg(*[f(n).alias(f"{n}__{k}") for _, n in names for k, f in stats.items()])
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.lit(n).alias("derived_name"), *[F.col(f"{n}__{k}").alias(k) for k in stats]) for c, n in names
    ]
    melted = wide.select("name", F.inline(F.array(*cells)))
    kinds = F.broadcast(found.to_frame(spark).select("column_name", "kind", "choice_train", "choice_test", "choice"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "low", "high")]
    return melted.join(kinds, "column_name").select("column_name", "kind", "choice_train", "choice_test", "choice", "derived_name", "name", "n", *rounded)


def log_shift(spark, folder):
    """The shift of the log with the largest W, from a grid judged in one ordered pass, and what it decides."""
    rows = _lines(spark, folder).select("name", (F.pow(F.lit(2.0), F.col("l_linenumber").cast("double")) + 0.25).alias("doubled"), "l_extendedprice")
    found = profile_stacked(rows, ["doubled", "l_extendedprice"], Config(log_shifts=LOG_SHIFTS))
    return found.to_frame(spark).select("column_name", "log_eps", F.round("w_raw", 5).alias("w_raw"), F.round("w_log", 5).alias("w_log"), "choice")


def category_mismatch(spark, folder):
    """Categories only the test part has."""
    return test_only_values(category_ratios(_events(spark, folder), ["bucket"], _flags()))


def mismatch_report(spark, folder):
    """Every disagreement between train and test over several columns."""
    return profile_stacked(_events(spark, folder), ["bucket", "value"]).report(spark)


def moments_zscore(spark, folder):
    """Mean, sample deviation and largest |z| of train, test and both together."""
    found = column_moments(_events(spark, folder), ["value"], _flags())
    sides = {p: found["value", p] for p in ("train", "test")}
    sides["combined"] = combine(list(sides.values()))
    rows = [(p, m.n, round(m.mean, 6), round(m.sd, 6), round(m.max_abs_z(), 6)) for p, m in sides.items()]
    return spark.createDataFrame(rows, "name string, n bigint, mean double, sd double, max_abs_z double")


def zscores(spark, folder):
    """z of every row against its own part's mean and deviation."""
    events = _events(spark, folder)
    found = column_moments(events, ["value"], _flags())

    def own(stat):
        a, b = (F.lit(getattr(found["value", p], stat)) for p in ("train", "test"))
        return F.when(F.col("name") == "train", a).otherwise(b)

    return events.select("event_id", "name", F.round(zscore(F.col("value"), own("mean"), own("sd")), 6).alias("z"))


def shift_log_column(spark, folder):
    """ln(x - min + smallest double), each part with its own minimum."""
    events = _events(spark, folder)
    found = column_moments(events, ["value"], _flags())
    low = F.when(F.col("name") == "train", F.lit(found["value", "train"].low)).otherwise(F.lit(found["value", "test"].low))
    return events.select("event_id", "name", F.round(shift_log(F.col("value"), low), 6).alias("value_log"))


def shapiro_w(spark, folder):
    """W of raw and shift-logged values of columns from three tables."""
    columns = {"lineitem": ["l_extendedprice", "l_discount", "l_tax"], "customer": ["c_acctbal"], "events": ["value"]}
    found = _union([shapiro_wilk(table(spark, folder, t), c) for t, c in columns.items()])
    return found.select("column_name", "n", F.round("w_raw", 5).alias("w_raw"), F.round("w_log", 5).alias("w_log"))


def normal_or_log(spark, folder):
    """Which shape each part suggests, and the reconciled choice."""
    lines = profile_stacked(_lines(spark, folder), ["l_extendedprice", "l_tax"])
    events = profile_stacked(_events(spark, folder), ["value"])
    return _union([p.to_frame(spark) for p in (lines, events)]).select(
        "column_name", "choice_train", "choice_test", "choice_combined", "choice"
    )


def transformed_column(spark, folder):
    """Continuous columns without outliers keep their raw or logged values."""
    config = Config(log_eps=1.0)
    lines = _lines(spark, folder).select(
        "name",
        (F.col("l_linenumber") + 0.25).alias("flat"),
        (F.pow(F.lit(2.0), F.col("l_linenumber")) + 0.25).alias("steep"),
    )
    found = profile_stacked(lines, ["flat", "steep"], config)
    wide = derive(lines, found, F.col("name"), ["name"], config)
    names = [c for c in wide.columns if c != "name"]
    cells = F.array(*[F.struct(F.lit(c).alias("derived_name"), F.round(F.col(c), 6).alias("value")) for c in names])
    return wide.select("name", F.inline(cells)).groupBy("name", "derived_name", "value").agg(F.count("*").alias("n"))


def state_feature(spark, folder):
    """Outlier state of every row."""
    events = _events(spark, folder)
    found = profile_stacked(events, ["value"])
    return derive(events, found, F.col("name"), ["event_id", "name"]).select("event_id", "name", "value_state")


def state_interaction(spark, folder):
    """The value where the state is zero."""
    events = _events(spark, folder)
    found = profile_stacked(events, ["value"])
    return derive(events, found, F.col("name"), ["event_id", "name"]).select("event_id", "name", "value_st_inter")


def derive_all(spark, folder):
    """The dispatcher over every numeric column of lineitem."""
    lines = _lines(spark, folder)
    found = profile_stacked(lines, LINE_NUMBERS)
    return derive(lines, found, F.col("name"), ["l_orderkey", "name"])


def derived_view(spark, folder):
    """The derived table published as a view and read by SQL."""
    publish(derive_all(spark, folder), "derived_lines")
    return spark.sql(
        "SELECT name, l_tax_state, count(*) AS n, round(sum(l_discount_st_inter), 4) AS discount "
        "FROM derived_lines GROUP BY name, l_tax_state"
    )


# Tables behind the plots


def histogram_table(spark, folder):
    """Counts per bin of a categorical column."""
    return histogram(_parts(spark, folder), "p_size").withColumn("bin_low", F.round("bin_low", 6))


def density_table(spark, folder):
    """Density per bin of a continuous column."""
    found = density(_events(spark, folder), "value", 64)
    return found.withColumn("bin_low", F.round("bin_low", 6)).withColumn("density", F.round("density", 8))


def class_rate_table(spark, folder):
    """Share of returned lines along the discount."""
    lines = table(spark, folder, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    found = class_rate(lines, "l_discount", "label", 20)
    return found.withColumn("bin_low", F.round("bin_low", 6)).withColumn("rate", F.round("rate", 8))


def kernel_density_table(spark, folder):
    """Density curves of a continuous column on a fixed grid."""
    found = kernel_density(_events(spark, folder), "value")
    return found.withColumn("x", F.round("x", 6)).withColumn("density", F.round("density", 8))


def smooth_rate_table(spark, folder):
    """Local quadratic smoother of a label along a price."""
    lines = table(spark, folder, "lineitem").withColumn("large", (F.col("l_quantity") * F.col("l_discount") > 1).cast("double"))
    found = smooth_rate(lines, "l_extendedprice", "large")
    return found.withColumn("x", F.round("x", 8)).withColumn("rate", F.round("rate", 6))


# Row identity, joins and splits


def row_number_dense(spark, folder):
    """Dense numbers in the order of a unique key, here the newest order first."""
    orders = table(spark, folder, "orders").select("o_orderkey", (-F.col("o_orderkey")).alias("newest"))
    return with_row_num(orders, "newest").select("o_orderkey", "row_num")


def row_number_files(spark, folder):
    """Dense numbers in file order."""
    return read_numbered(spark, f"{folder.rstrip('/')}/orders.parquet").select("o_orderkey", "row_num")


def row_number_text(spark, folder):
    """Dense numbers in the order of a string key."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("name"))
    return with_row_num(orders, "name", rows_per_bucket=4_096).select("o_orderkey", "name", "row_num")


def row_number_csv(spark, folder):
    """Dense numbers in file order over a folder of CSV files."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    path = scratch_path(spark, "orders")
    orders.repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).csv(path)
    return read_numbered(spark, path, format="csv", schema=orders.schema, header=True).select("o_orderkey", "row_num")


def split_null_keys(spark, folder):
    """Rows without a key are held out, by name and by filters alike; a share need not be a whole percent."""
    orders = table(spark, folder, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("k"))
    out = [named_split(orders, "k", SEED).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("named").alias("way"), "name", "n")]
    for share in (0.75, 0.3333):
        for name, side in zip(("train", "test"), keyed_split(orders, "k", SEED, share)):
            out.append(side.agg(F.count("*").alias("n")).select(F.lit(f"keyed {share}").alias("way"), F.lit(name).alias("name"), "n"))
    return _union(out)


def bernoulli_checked(spark, folder):
    """A Bernoulli draw holds rows of the table only, each once, about the share asked for, and again for the same seed."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    once, again = (bernoulli_sample(orders, SEED).withColumn("n", F.lit(1)) for _ in range(2))
    pairs = once.join(again.withColumnRenamed("n", "m"), "o_orderkey", "full")
    drawn = orders.withColumn("there", F.lit(True)).join(pairs, "o_orderkey", "full")
    share = F.count("n") / F.count("there")
    return drawn.agg(
        F.count_if(F.col("n").isNotNull() & F.col("there").isNull()).alias("strangers"),
        (F.count("n") - F.count_distinct(F.when(F.col("n").isNotNull(), F.col("o_orderkey")))).alias("repeats"),
        share.between(0.7, 0.8).alias("plausible"),
        F.count_if(F.col("n").isNull() != F.col("m").isNull()).alias("changed"),
        F.count("there").alias("n"),
    )


def constant_side(spark, folder):
    """A column that does not vary in test: its states are 0 there, and the report says so."""
    events = _events(spark, folder).withColumn("value", F.when(F.col("name") == "train", F.col("value")).otherwise(5.25))
    found = profile_stacked(events, ["value"])
    kinds = F.array(*[F.lit(kind) for kind, _ in found["value"].mismatches()])
    rows = derive(events, found, F.col("name"), ["event_id", "name"])
    return rows.select(
        "event_id", "name", F.round("value_state", 6).alias("state"), F.round("value_st_inter", 6).alias("interaction"),
        F.array_contains(kinds, "constant").alias("reported"),
    )


def derive_stored_profile(spark, folder):
    """Rare values beyond the inline list, from a profile written to storage and read again."""
    events = _events(spark, folder)
    path = scratch_path(spark, "profile")
    profile_stacked(events, ["bucket"], Config(inline_rare=2)).write(spark, path)
    found = Profile.read(spark, path)
    return derive(events, found, F.col("name"), ["event_id", "bucket"]).select("event_id", "bucket", F.round("bucket_trunc_cat", 6).alias("bucket_trunc_cat"))


def attach_columns_join(spark, folder):
    """Further columns by left join; documents without labels keep nulls."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    return attach_columns(documents, table(spark, folder, "labels"), "doc_id")


def attach_labels_join(spark, folder):
    """Labels on the left, features on the right."""
    return attach_labels(table(spark, folder, "labels"), table(spark, folder, "documents"), "doc_id", "quality", ["n_chars"])


def split_holdout(spark, folder):
    """Keyed split of the orders."""
    return named_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", SEED)


def holdout_anti_join(spark, folder):
    """Orders outside the keyed sample, by anti-join."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return holdout(orders, keyed_split(orders, "o_orderkey", SEED)[0], "o_orderkey")


def bernoulli(spark, folder):
    """Independent 75 % sample."""
    return bernoulli_sample(table(spark, folder, "orders"), SEED)


def union_sources(spark, folder):
    """Account balances of customers on top of suppliers."""
    customers = table(spark, folder, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, folder, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return customers.unionByName(suppliers)


# Encoding and assembly


def category_index(spark, folder):
    """Index of each category, most frequent first."""
    out = []
    for t, column in (("orders", "o_orderpriority"), ("part", "p_size")):
        df = table(spark, folder, t).select(F.col(column).cast("string").alias("value"))
        indexed = fit_category_index(df, ["value"]).transform(df)
        counts = indexed.groupBy("value", "value_Index").agg(F.count("*").alias("n"))
        out.append(counts.select(F.lit(column).alias("column_name"), "value", F.col("value_Index").cast("bigint").alias("position"), "n"))
    return _union(out)


def category_index_large(spark, folder):
    """The same index as a distributed table, for vocabularies too large for a model."""
    found = category_table(table(spark, folder, "part"), "p_name")
    return found.select("value", F.col("index").cast("bigint").alias("position"))


def one_hot_vectors(spark, folder):
    """Slot of each row's category in its one-hot vector; the last category has none."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"))
    indexed = fit_category_index(parts, ["size"], "error").transform(parts)
    slots = vector_to_array(F.col("size_classVec"))
    return (
        one_hot(["size"]).fit(indexed).transform(indexed)
        .select("p_partkey", slots.alias("slots"))
        .select(
            "p_partkey",
            (F.array_position("slots", 1.0) - 1).cast("bigint").alias("slot"),
            F.size("slots").cast("bigint").alias("width"),
            F.aggregate("slots", F.lit(0.0), lambda a, b: a + b).alias("total"),
        )
    )


def _assembled(spark, folder, config: Config) -> DataFrame:
    lines = _lines(spark, folder).withColumn("returned", (F.col("l_returnflag") == "R").cast("double"))
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    train, test = (lines.filter(F.col("name") == p) for p in ("train", "test"))
    out = assemble(train, test, "l_orderkey", "returned", columns, config=config)
    cells = vector_to_array(F.col("features"))
    values = [F.round(cells[i], 6).alias(f"f{i}") for i in range(len(columns))]
    return out.train.select(F.lit("train").alias("name"), "id", "label", *values).unionByName(
        out.test.select(F.lit("test").alias("name"), "id", F.lit(None).cast("double").alias("label"), *values)
    )


def assemble_vectors(spark, folder):
    """Vectors of four columns with their label."""
    return _assembled(spark, folder, Config())


def standard_scale(spark, folder):
    """The same vectors divided by the deviation of the train part."""
    return _assembled(spark, folder, Config(scale_data=True))


def category_index_keep(spark, folder):
    """Null and unseen categories get the same index from a model and from a joined table."""
    sizes = table(spark, folder, "part").select(F.col("p_size").cast("string").alias("value"), (F.col("p_size") <= 40).alias("known"))
    rows = sizes.select(F.when(F.col("value") != "7", F.col("value")).alias("value"), "known")
    out = []
    for path, most in (("model", 100_000), ("table", 0)):
        indexed = fit_category_index(rows.filter("known"), ["value"], "keep", most).transform(rows)
        counts = indexed.groupBy("value", F.col("value_Index").cast("bigint").alias("position")).agg(F.count("*").alias("n"))
        out.append(counts.select(F.lit(path).alias("path"), "value", "position", "n"))
    return _union(out)


def _encoded(spark, folder, config: Config) -> tuple[DataFrame, int]:
    """Vectors of a value and a category; what test rows lack is a label."""
    events = _events(spark, folder).withColumn("label", F.lit(1.0))
    train, test = (events.filter(F.col("name") == p) for p in ("train", "test"))
    out = assemble(train, test, "event_id", "label", ["value", "bucket"], ["bucket"], config)
    rows = out.train.select("id", "features").unionByName(out.test)
    return rows.select("id", vector_to_array("features").alias("cells")), len(out.inputs) - 1


def assemble_encoded(spark, folder):
    """Raw value, raw category, index and k - 1 one-hot slots, fitted on both tables and scaled together."""
    config = Config(cat_transform=True, scale_data=True, fit_on="union", keep_raw_categories=True)
    rows, before = _encoded(spark, folder, config)
    slots = F.slice("cells", before + 1, F.size("cells") - before)
    lit = rows.withColumn("slots", slots).withColumn("top", F.array_max("slots"))
    cell = lambda i: F.round(F.col("cells")[i], 6)
    return lit.select(
        "id", F.size("cells").cast("bigint").alias("width"), cell(0).alias("value"), cell(1).alias("bucket"), cell(2).alias("place"),
        F.when(F.col("top") > 0, F.array_position("slots", F.col("top")) - 1).otherwise(-1).cast("bigint").alias("slot"),
        F.round("top", 6).alias("top"),
    )


def assemble_encoded_train(spark, folder):
    """The same category fitted on train alone: values only test has are zeros, like the last category."""
    rows, before = _encoded(spark, folder, Config(cat_transform=True))
    slots = F.slice("cells", before + 1, F.size("cells") - before)
    slot = F.coalesce(F.array_position(slots, F.lit(1.0)), F.lit(0)) - 1
    return rows.select("id", F.size("cells").cast("bigint").alias("width"), slot.cast("bigint").alias("slot"))


# Evaluation and models


def confusion_metrics(spark, folder):
    """Counts and ratios of a fixed rule."""
    found = confusion(_rule_scored(spark, folder))
    ratios = ["tpr", "fpr", "roc", "precision", "recall", "fall_out"]
    return found.select("n", "p", "neg", "tp", "fp", *[F.round(c, 8).alias(c) for c in ratios])


def squared_error(spark, folder):
    """Total and mean squared error of the same rule."""
    return confusion(_rule_scored(spark, folder)).select(F.round("sse", 4).alias("sse"), F.round("mse", 8).alias("mse"))


def split_summary_table(spark, folder):
    """Mean and deviation of the metrics over five hold-outs, taken in one pass."""
    found = split_summary(split_metrics(_rule_scored(spark, folder), "id", SEEDS))
    return found.select(*[F.round(c, 6).alias(c) for c in ("mroc", "sdroc", "mmse", "sdmse")], "splits")


def auc(spark, folder):
    """Exact area under ROC of a score with many distinct values."""
    lines = table(spark, folder, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    return area_under_roc(lines, "l_extendedprice", "label").select(F.round("auc", 8).alias("auc"), "positives", "negatives")


def _model_table(spark, folder) -> DataFrame:
    """Labels that the columns explain: the return flag is independent of them in these tables, and a fit could not show."""
    lines = table(spark, folder, "lineitem").withColumn(
        "large", (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 50000).cast("double")
    )
    return assemble(lines, lines, "l_orderkey", "large", ["l_quantity", "l_extendedprice", "l_tax"]).train


def _fit_config(**settings) -> Config:
    """Fits of this size are bound by the number of tasks, so the rows stay in few partitions."""
    return Config(rows_per_partition=250_000, parallelism=8, **settings)


def _validated(spark, folder, config: Config) -> DataFrame:
    """Per hold-out what can be recounted: its rows and labels, a 0/1 prediction for each row, better than chance."""
    found = validate(_model_table(spark, folder), config)
    complete = (F.col("p") + F.col("neg") == F.col("n")).alias("complete")
    return found.select("seed", "n", "actual_pos", "actual_neg", complete, (F.col("recall") > F.col("fall_out")).alias("better"))


def lr_cv(spark, folder):
    """Logistic regression, ten-fold cross-validated over the whole grid, on five hold-outs."""
    return _validated(spark, folder, _fit_config(model="lr"))


def svm(spark, folder):
    """Linear SVM on five hold-outs."""
    return _validated(spark, folder, _fit_config(model="svm"))


def gbt(spark, folder):
    """Gradient-boosted trees on five hold-outs."""
    return _validated(spark, folder, _fit_config(model="gbt"))


def _documents(spark, folder) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("chars"),
        F.size(F.split("text", r"\s+")).cast("double").alias("words"),
        F.regexp_count("text", F.lit(r"[0-9]")).cast("double").alias("digits"),
    )
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    marked = attach_columns(documents, labels, "doc_id")
    return marked.filter("quality IS NOT NULL"), marked.filter("quality IS NULL").drop("quality")


def score_unlabelled(spark, folder):
    """Refit on all labelled documents, score the others; every prediction is one of the two labels."""
    train, test = _documents(spark, folder)
    out = assemble(train, test, "doc_id", "quality", ["chars", "words", "digits"])
    scored = score(refit(out.train, _fit_config(model="lr")), out.test)
    path = scratch_path(spark, "predictions")
    write_predictions(scored, "lr", path)
    return spark.read.parquet(path).select("model_name", "id", F.col("prediction").isin(0.0, 1.0).alias("valid"))


def score_later(spark, folder):
    """A run's stored artefact, read again, scores a later table: its ids, slots (none for an unseen hour) and predictions."""
    noisy = F.col("value") + F.pmod(F.col("event_id") * 7919, F.lit(40)) > 35
    events = table(spark, folder, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"), noisy.cast("double").alias("label"))
    named = named_split(events, "event_id", SEED)
    train, test = named.filter("name = 'train'").drop("name"), named.filter("name = 'test'").drop("name", "label")
    config = _fit_config(model="lr", cat_transform=True, num_splits=2, nfolds=3)
    stored = scratch_path(spark, "artefact")
    run(train, test, "event_id", "label", ["value", "hour"], scratch_path(spark, "champion"), config=config, artefact_path=stored)
    later = test.withColumn("hour", F.when(F.col("event_id") % 10 == 0, 99.0).otherwise(F.col("hour"))).withColumn("event_id", F.col("event_id") + 1_000_000)
    found = Scorer.read(spark, stored).score(later).withColumn("cells", vector_to_array("features"))
    slots = F.slice("cells", 3, F.size("cells") - 2)
    slot = F.coalesce(F.array_position(slots, F.lit(1.0)), F.lit(0)) - 1
    return found.select("id", F.size("cells").cast("bigint").alias("width"), slot.cast("bigint").alias("slot"), F.col("prediction").isin(0.0, 1.0).alias("valid"))


def workflow_run(spark, folder):
    """The whole run on events: profile, derive, encode, scale, validate, gate, refit, score."""
    noisy = F.col("value") + F.pmod(F.col("event_id") * 7919, F.lit(40)) > 35
    bucket, hour = F.floor(F.col("value") / 10), F.hour("ts")
    events = table(spark, folder, "events").select(
        "event_id", "value", bucket.cast("double").alias("bucket"), hour.cast("double").alias("hour"), noisy.cast("double").alias("label")
    )
    named = named_split(events, "event_id", SEED)
    train, test = named.filter("name = 'train'").drop("name"), named.filter("name = 'test'").drop("name", "label")
    config = _fit_config(model="gbt", cat_transform=True, scale_data=True, fit_on="union")
    done = run(train, test, "event_id", "label", ["value", "bucket", "hour"], scratch_path(spark, "champion"), scratch_path(spark, "predictions"), config)
    decision = done.decision.select(F.col("name").alias("model_name"), "accepted")
    valid = F.col("prediction").isin(0.0, 1.0).alias("valid")
    return done.predictions.select("model_name", "id", valid).join(decision, "model_name")


def champion_gate_row(spark, folder):
    """One rule's summary against another's, recorded as champion before."""

    def record(rule: str, name: str) -> DataFrame:
        found = split_summary(split_metrics(_rule_scored(spark, folder, rule), "id", SEEDS))
        return found.select("mroc", "sdroc", F.lit(name).alias("name"))

    path = scratch_path(spark, "champion")
    write_champion(record("l_tax > 0.04", "tax"), path)
    found = champion_gate(read_champion(spark, path), record("l_discount > 0.05", "discount"))
    return found.select("name", *[F.round(c, 6).alias(c) for c in ("mroc", "sdroc", "best_mroc")], "accepted")


# Sources, sinks and heads


def csv_roundtrip(spark, folder):
    """Customers written as CSV and read back with their schema."""
    customers = table(spark, folder, "customer")
    path = scratch_path(spark, "customers") + ".csv"
    write_csv(customers, path)
    return read_csv(spark, path, customers.schema)


def read_roles(spark, folder):
    """The labelled and the unlabelled table by role."""
    paths = {"train": f"{folder.rstrip('/')}/labels.parquet", "test": f"{folder.rstrip('/')}/documents.parquet"}
    return _union(
        [read_role(spark, r, paths).select(F.lit(r).alias("name"), "doc_id") for r in ("train", "test")]
    )


def sample_head(spark, folder):
    """The first twenty orders by key."""
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "categorical_profile": categorical_profile,
    "balance_ratio": balance,
    "category_ratio": category_ratio,
    "truncate_rare": truncate_rare,
    "binarize": binarize_column,
    "category_passthrough": category_passthrough,
    "category_mismatch": category_mismatch,
    "mismatch_report": mismatch_report,
    "moments_zscore": moments_zscore,
    "zscores": zscores,
    "shift_log": shift_log_column,
    "shapiro_w": shapiro_w,
    "normal_or_log": normal_or_log,
    "transformed_column": transformed_column,
    "state": state_feature,
    "state_interaction": state_interaction,
    "derive_all": derive_all,
    "derived_view": derived_view,
    "histogram": histogram_table,
    "density": density_table,
    "kernel_density": kernel_density_table,
    "smooth_rate": smooth_rate_table,
    "derive_branches": derive_branches,
    "log_shift": log_shift,
    "row_number_text": row_number_text,
    "class_rate": class_rate_table,
    "row_number_dense": row_number_dense,
    "row_number_files": row_number_files,
    "attach_columns": attach_columns_join,
    "attach_labels": attach_labels_join,
    "split_holdout": split_holdout,
    "holdout_anti_join": holdout_anti_join,
    "bernoulli_sample": bernoulli,
    "union_sources": union_sources,
    "category_index": category_index,
    "category_index_large": category_index_large,
    "one_hot": one_hot_vectors,
    "assemble": assemble_vectors,
    "standard_scale": standard_scale,
    "confusion_metrics": confusion_metrics,
    "sse": squared_error,
    "split_summary": split_summary_table,
    "auc": auc,
    "lr_cv": lr_cv,
    "svm": svm,
    "gbt": gbt,
    "score_unlabelled": score_unlabelled,
    "workflow_run": workflow_run,
    "score_later": score_later,
    "category_index_keep": category_index_keep,
    "assemble_encoded": assemble_encoded,
    "assemble_encoded_train": assemble_encoded_train,
    "row_number_csv": row_number_csv,
    "split_null_keys": split_null_keys,
    "bernoulli_checked": bernoulli_checked,
    "constant_side": constant_side,
    "derive_stored_profile": derive_stored_profile,
    "champion_gate": champion_gate_row,
    "csv_roundtrip": csv_roundtrip,
    "read_roles": read_roles,
    "sample_head": sample_head,
}
