"""Quality rules per document and verdicts per host.

Every document is measured by built-in functions inside its row. Rule failures are then
counted per host, each host's failure rate is shrunk towards the corpus by a beta prior
fitted to all hosts, and hosts that fail too often take their documents with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from evtlake.llm.common import add_facts, stored

WHITE = " \t\n\x0b\f\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
MIN_WORDS = 50
#: A document also counts against its host when symbols exceed this share of its word characters,
#: or equal lines this share of its lines. Such documents themselves stay.
SYMBOL_SHARE, LINE_SHARE = 0.1, 0.3
#: A host is rejected when its shrunk failure rate exceeds this.
HOST_LIMIT = 0.8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it, wherever the optimiser moves it."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(words: Column) -> Column:
    """Number of words in windows of three words that occur at least twice; windows are compared by a 64-bit hash."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(found: Column) -> Column:
        starts = F.filter(found, lambda x, i: F.coalesce(x["h"] == F.get(found, i - 1)["h"], F.lit(False))
                          | F.coalesce(x["h"] == F.get(found, i + 1)["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    def counted(hashed: Column) -> Column:
        placed = F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), 0).otherwise(bind(F.sort_array(placed), covered))

    return F.when(F.size(words) >= 3, bind(hashes, counted)).otherwise(0).cast("long")


def _word_measures(words: Column) -> Column:
    n = F.size(words).cast("long")
    return bind(_repeated(words), lambda r: F.struct(
        n.alias("n_words"), r.alias("n_repeat_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        ((n < MIN_WORDS) | (100 * r > 50 * n)).alias("base_failed")))


def measured(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """Host, the measures, base_failed and counted per row, with the columns ``keep``.

    Words are runs of anything but ASCII white space. NULL texts have no words.
    """
    kept = dict(keep or {})
    text, core = F.col("_t"), F.btrim(F.col("_t"), F.lit(WHITE))
    words = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, WHITE_RUN))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    sized = docs.select(*[c.alias(n) for n, c in kept.items()], F.col(host_col).alias("host"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("_t")).select(
        *kept, "host", bind(words, _word_measures).alias("_m"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("different"))).alias("_l"))
    m, line = F.col("_m"), F.col("_l")
    out = sized.select(
        *kept, "host", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), "n_symbols",
        (line["n"] - line["different"]).cast("long").alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
        m["base_failed"].alias("base_failed"), line["n"].alias("_n_lines"))
    counted = F.col("base_failed") | (F.col("n_symbols") > SYMBOL_SHARE * F.col("word_chars")) | (
        F.col("n_dup_lines") > LINE_SHARE * F.col("_n_lines"))
    return out.withColumn("counted", counted).drop("_n_lines")


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, host_rate and host_rejected from the rows of ``measured``; NULL is a host too.

    The prior has the mean of all rows and the variance between hosts that is left when
    the binomial variance is taken off; its strength stays between 1 and a million rows.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("counted").alias("failed"))
    sums = hosts.agg(F.sum("failed").alias("f"), F.sum("n_docs").alias("n"), F.count("*").alias("k"),
                     F.sum(F.col("failed") * F.col("failed") / F.col("n_docs")).alias("q"))
    mean = F.col("f") / F.col("n")
    between = F.col("q") / F.col("n") - mean * mean - mean * (1 - mean) * F.col("k") / F.col("n")
    strength = F.when(between > 0, F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0)), F.lit(1e6))).otherwise(1e6)
    prior_mean, prior_n = sums.select(mean).scalar(), sums.select(strength).scalar()
    rate = (F.col("failed") + prior_mean * prior_n) / (F.col("n_docs") + prior_n)
    return hosts.select("host", "n_docs", F.round(rate, 9).alias("host_rate")).withColumn("host_rejected", F.col("host_rate") > limit)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, host_rate and kept, one row per row of ``docs``.

    NULL and empty texts fail for lack of words. Rows are judged one by one, so repeated rows
    and NULL ids need no care; an empty table gives no rows; other columns are ignored.
    """
    rows = stored(measured(docs, text_col, host_col, {"doc_id": F.col(id_col)}), "rule-rows")
    hosts = stored(host_verdicts(rows), "rule-hosts")
    judged = add_facts(rows, hosts, "host", "n_docs", F.struct("doc_id", *MEASURES))
    return judged.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rate")


def accepted(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns.

    Measures are computed once for the host table and again for the rows themselves: that is
    cheaper than storing all texts in between. Only rejected hosts are joined.
    """
    hosts = stored(host_verdicts(measured(docs, text_col, host_col)), "rule-hosts")
    rows = measured(docs, text_col, host_col, {"_row": F.struct("*")}).where(~F.col("base_failed")).select("_row", "host")
    bad = hosts.where("host_rejected").select("host", "n_docs", F.lit(True).alias("bad"))
    judged = add_facts(rows, bad, "host", "n_docs", F.col(f"_row.{text_col}"))
    return judged.where(F.col("bad").isNull()).select("_row.*")
