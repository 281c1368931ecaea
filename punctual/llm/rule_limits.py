"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each text is described by exact counts; two fixed base rules reject first. Further rules
reject texts whose statistic lies above a cutoff. For every rule, stratum (language) and
cutoff of a fixed grid, the labelled good documents that the cutoff would reject are
counted; with n good documents and k false rejections, P(Binomial(n, risk) <= k) is the
exact p-value of "rejects more than ``RISK`` of the good". A cutoff holds where that
p-value is at most ``ERROR`` divided by the number of tests (Bonferroni over rules,
cutoffs and strata); the strictest such cutoff is used. The risk is shared among rules, so
together they reject at most ``RISK`` of a stratum's good documents, with confidence
1 - ``ERROR``. A stratum with too few labels gets no cutoff and keeps what the base keeps.

Null and empty texts have no words and fail the base; documents without labels, labels
without documents and null labels do not count; several labels of one document count by
their least. A null language is a stratum of its own. Equal rows get equal results,
other columns are not touched, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.session import cut_lineage

RISK, ERROR = 0.02, 0.05
BLANKS = r"[\x20\x09-\x0D]+"
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.5),
    "repeat_share": (0.05, 0.1, 0.2, 0.3, 0.4),
    "mean_word_chars": (7.0, 8.0, 9.0, 10.0, 12.0, 16.0),
}


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document its id, stratum, counts and the statistics of the rules."""
    texts = docs.select(F.col(id_col), F.coalesce(F.col(lang_col), F.lit("")).alias("_stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    words = texts.withColumns({
        "_words": F.filter(F.split("_text", BLANKS), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.regexp_replace("_text", BLANKS, "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("bigint"),
    }).drop("_text")
    counted = words.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "_n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_windows": F.transform(
            F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))
        ),
    }).drop("_words", "_lines")
    ordered = counted.withColumn(
        "_ordered",
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_windows")
    same = lambda x, k: x["h"] == F.get("_ordered", k)["h"]
    hits = ordered.withColumn(
        "_hits",
        F.sort_array(F.filter(F.transform("_ordered", lambda x, k: F.when(F.coalesce(same(x, k + 1), F.lit(False)) | F.coalesce(same(x, k - 1), F.lit(False)), x["i"])), lambda i: i.isNotNull())),
    ).drop("_ordered")
    # each window adds the words up to the next repeated window, three at most
    covered = F.aggregate(F.transform("_hits", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_hits", k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    counts = hits.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_hits")
    share = lambda part, of: F.col(part) / F.greatest(F.col(of), F.lit(1))
    return counts.select(
        id_col, "_stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "_n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("mean_word_chars"),
    )


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed exactly in logarithms; 1 from the mean on, where nothing is ever certified."""
    odds = F.lit(p / (1 - p))
    first = n * F.log1p(F.lit(-p))
    state = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1) / i * odds)
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(steps, state, add)["sum"])


def cutoffs(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row per stratum with the strictest certified cutoff of each rule (null: none), and per rule n, k and the p-value."""
    good = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")).where("_label = 1")
    held = rows.where("not base_failed").join(good, rows[id_col] == good["_id"])
    pairs = [(rule, c) for rule, grid in GRIDS.items() for c in grid]
    counts = held.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col(rule) > c, 1)).alias(f"_k{i}") for i, (rule, c) in enumerate(pairs)])
    strata = counts.select(F.count(F.lit(1)).alias("_strata"))
    long = counts.select("_stratum", "_n", F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"_k{i}").alias("k")) for i, (rule, c) in enumerate(pairs)])).alias("_t")).select("_stratum", "_n", "_t.*")
    tested = long.withColumn("p", at_most(F.col("k"), F.col("_n"), RISK / len(GRIDS))).join(F.broadcast(strata))  # one row
    holds = tested.where(F.col("p") <= F.lit(ERROR) / (len(pairs) * F.col("_strata")))
    return holds.groupBy("_stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"_max_{rule}") for rule in GRIDS])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Per document its counts, whether the base failed it, and whether it is kept."""
    rows = cut_lineage(described(docs, id_col, text_col, lang_col))
    limits = cutoffs(rows, labels, id_col, label_col)
    passes = F.lit(True)
    for rule in GRIDS:
        passes = passes & (F.col(rule) <= F.coalesce(F.col(f"_max_{rule}"), F.lit(float("inf"))))
    return rows.join(limits, "_stratum", "left").select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & passes).alias("kept"))
