"""Quality rules: text statistics as columns, and a learned decision list over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplane.llm.common import is_word, let, words
from strataplane.llm.decision_list import Rule, learn, verdict

#: Labelled documents that the rules are fitted on: those of the smallest hashed doc_id.
FIT_ROWS = 4000

#: Ratios over which conditions are learned; all come from the columns of ``statistics``.
FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "bangs_per_word": "n_bangs / n_words",
    "upper_share": "n_upper / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "words_per_line": "n_words / n_lines",
}


def _taken(text, kind: str):
    """Characters of ``text`` in the class ``kind``."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]+", ""))).cast("long")


def _repeated_places(shingle):
    """Sorted places of the windows that occur twice or more, from the windows' hashes in order."""
    ranked = F.sort_array(F.transform(shingle, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = let(
        ranked,
        lambda r: F.zip_with(
            F.slice(r, 1, F.size(r) - 1),
            F.slice(r, 2, F.size(r) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        ),
    )
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bangs (long).

    Words are maximal runs outside ``\\x20\\x09-\\x0D``.  A null or blank text
    has no words and zeros throughout.  Rows are independent: repeated doc_ids
    give repeated rows.  Columns other than ``keep`` are ignored, so clashing
    names do no harm.
    """
    id_cols = [F.col(c) for c in keep]
    base = docs.select(F.struct(*id_cols).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    lined = base.select("k", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), is_word).alias("l"))
    counted = lined.select(
        "k",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _taken(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _taken(F.col("t"), "A-Z").alias("n_upper"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))).alias("s"),
    )
    # windows' hashes, shifted up to make room for their places, are sorted as plain numbers
    room = F.length(F.bin(F.size("s")))
    ranked = counted.withColumn("b", room).withColumn("r", F.sort_array(F.transform("s", lambda h, i: F.call_function("shiftleft", h, F.col("b")).bitwiseOR(i.cast("long")))))

    def top(x):
        return F.call_function("shiftright", x, F.col("b"))

    def place(x):
        return (x - F.call_function("shiftleft", top(x), F.col("b"))).cast("int")

    met = ranked.withColumn("f", F.filter("r", lambda x, i: (top(x) == top(F.get("r", i + 1))) | (top(x) == top(F.get("r", i - 1))))).drop("r")
    # where the bits left of two different hashes agree, the whole hashes decide
    mixed = F.size(F.filter("f", lambda x, i: (top(x) == top(F.get("f", i + 1))) & (F.get("s", place(x)) != F.get("s", place(F.get("f", i + 1)))))) > 0
    none = F.array().cast("array<int>")
    twice = met.withColumn("at", F.when(F.size("f") == 0, none).when(mixed, _repeated_places(F.col("s"))).otherwise(F.sort_array(F.transform("f", place)))).drop("s", "f", "b")
    m = F.size("at")
    steps = F.zip_with(F.slice("at", 1, F.greatest(m - 1, F.lit(0))), F.slice("at", 2, F.greatest(m - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(m > 0, F.aggregate(steps, F.lit(3), lambda acc, x: acc + x)).otherwise(F.lit(0))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_bangs"]
    # a generator of one struct: filters on the counts stay above it and don't repeat what computes them
    once = twice.select("k", F.explode(F.array(F.struct(*names, covered.cast("long").alias("n_repeat_words")))).alias("c"))
    return once.select("k.*", "c.*")


def with_features(stats: DataFrame) -> DataFrame:
    """Adds the ratios of FEATURES; 0 where the divisor is 0."""
    return stats.withColumns({k: F.coalesce(F.expr(f"try_divide({a}, {b})"), F.lit(0.0)) for k, v in FEATURES.items() for a, b in [v.split(" / ")]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Rules that reject, learned from ``labels`` (doc_id, quality 0/1) on at most ``rows`` documents.

    Null ids and labels are left out; no labels give no rules.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows are broadcast
    got = with_features(statistics(pairs, keep=("doc_id", "quality"))).where("n_words > 0").select("doc_id", "quality", *FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(2 * rows).collect()
    if not got:
        return []
    data = {f: np.array([r[f] for r in got], dtype=float) for f in FEATURES}
    return learn(data, np.array([r["quality"] == 0 for r in got]))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """statistics() with base_failed and kept: false where the base rules or the learned list reject."""
    out = with_features(statistics(docs, keep=keep)).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop(*FEATURES)


def filter_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    carried = docs.select(row, F.col("text").alias("text"))
    return judge(carried, rules, keep=("row",)).where("kept").select("row.*")
