"""Quality rules: a threshold table compiled into Spark projections.

Every metric is a built-in expression over the text of its own row (no user
function, no shuffle): one scan, one row in, one row out. The only work above
linear is the sort of a row's own three-word windows, done only for rows in
which a window repeats.

Defined results: a null or empty text has no words and zero counts and fails
the base rule (fewer than 50 words); ratios with a zero denominator are 0;
repeated rows are judged each on their own; other columns pass through
untouched, whatever their names (a column of the name of a result is replaced).
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import SPACE

#: Frequent function words of the languages that the table knows.
STOP_WORDS = {
    "en": "a an and are as at be by for from he in is it of on or that the this to was were with".split(),
    "de": "auf aus bei das dem den der des die ein eine einer er es für im in ist mit nicht sich und "
          "von war zu".split(),
    "fr": "au avec dans de des du elle en est et il la le les par pas pour que qui sur un une".split(),
    "es": "al con de del el en es la las lo los no para por que se su un una y".split(),
}
#: Function words of further languages, whose texts the rule on stop words spares.
FURTHER_WORDS = {
    "cs": "aby ale jako jeho jsem jsou které který než nebo pro při také však že".split(),
    "da/no/sv": "att av blev det efter eller från för har hon ikke inte jeg kan med men mot och också og "
                "om på skal som till var være".split(),
    "fi": "ei ja joka kun mutta myös niin oli ovat sekä tai että".split(),
    "hu": "az csak egy ez hogy is már meg mint nem vagy volt és".split(),
    "id/ms": "adalah akan dalam dan dari dengan ini itu ke oleh pada tidak untuk yang".split(),
    "it": "alla anche che come con dei del della di gli ha il nel nella non per più sono".split(),
    "nl": "aan dat de door een het hij maar met naar niet ook op te van voor wordt zijn".split(),
    "pl": "ale czy dla do jak jest lub na nie od oraz po przez się są tym że".split(),
    "pt": "ao as com como da das do dos em foi mais mas na não os ou pela pelo são uma".split(),
    "ro": "ale care ce cu din este fi la mai nu pe pentru prin sau sunt și în".split(),
    "tr": "bir bu da daha de gibi için ile ne olan olarak sonra ve çok".split(),
    "vi": "các của cho có không là một người những trong và được".split(),
}
#: Scripts by the first word of their characters' names.
SCRIPTS = {"CJK": "Han"}


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; a missing bound does not bind."""
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table of the verdict (the base rule comes before it).
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("mark_ratio", None, 0.3),
    Rule("pipe_ratio", None, 0.2),
    Rule("shout_ratio", None, 0.6),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_ratio", None, 0.5),
)


def _counts(docs: DataFrame, text: str) -> DataFrame:
    """Columns _w (words), _bare (words in lower case without marks), _letters, and the
    contract's counts. ``docs`` has no columns but the text and a struct of the row."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(t, SPACE, -1), lambda w: w != F.lit(""))
    d = docs.withColumn("_t", t).withColumn("_w", words).withColumn("_l", lines)
    n = F.size("_w")
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_h", windows)
    # Windows of a row in the order of their hashes; those next to an equal one repeat.
    d = d.withColumn("_s", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.arrays_zip(F.col("_h").alias("h"),
                                  F.sequence(F.lit(0), F.size("_h") - 1).alias("p")))))
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter(
        F.transform("_s", lambda x, i: F.struct(
            x["p"].alias("p"),
            ((F.coalesce(F.get("_s", i - 1)["h"] == x["h"], F.lit(False)))
             | (F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)))).alias("again"))),
        lambda x: x["again"]), lambda x: x["p"])))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return (d.withColumn("_bare", F.transform("_w", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?"))))
            .withColumn("_letters", F.length(F.regexp_replace("_t", r"\P{L}+", "")))
            .withColumn("n_words", n.cast("long"))
            .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
            .withColumn("n_symbols", (F.length("_t") - F.length(
                F.translate("_t", "#*$%&|<>", ""))).cast("long"))
            .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
            .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")))


def _among(words: str, known: list[str]) -> Column:
    """How many of an array's words are known (a hash set's look-up per word)."""
    return F.size(F.filter(words, lambda w: w.isin(known))) if known else F.lit(0)


def _metrics(stop_words: list[str]) -> dict[str, Column]:
    """Each metric of the table over the counts of ``_counts``."""
    def per(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(F.lit(0.0))
    n = F.col("n_words")
    upper = F.length(F.regexp_replace("_t", r"\P{Lu}+", ""))
    return {
        "mean_word_chars": per(F.col("word_chars"), n),
        "symbol_ratio": per(F.col("n_symbols"), n),
        "mark_ratio": per(F.length("_t") - F.length(F.translate("_t", "!?", "")), n),
        "pipe_ratio": per(F.size(F.filter("_w", lambda w: w == F.lit("|"))), n),
        "shout_ratio": per(upper, F.col("_letters")),
        "stop_ratio": per(_among("_bare", stop_words), n),
        "dup_line_ratio": per(F.col("n_dup_lines"), F.size("_l")),
        "repeat_ratio": per(F.col("n_repeat_words"), n),
    }


def _spared(stop_words: list[str], further: list[str], low: float) -> Column:
    """Texts that the rule on stop words says nothing about: most letters are of scripts
    in which no stop word is written, or ``low`` of the words are ``further`` words."""
    names = sorted({unicodedata.name(c).split()[0] for w in stop_words for c in w if c.isalpha()})
    scripts = "".join(rf"\p{{Is{SCRIPTS.get(n, n.title())}}}" for n in names)
    other = F.length(F.regexp_replace("_t", rf"[\P{{L}}{scripts}]+", ""))
    return (2 * other > F.col("_letters")) | (_among("_bare", further) >= low * F.col("n_words"))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
          min_words: int = 50, max_repeat_percent: int = 50,
          stop_words: dict[str, list[str]] | None = None) -> DataFrame:
    """Add the counts, ``base_failed``, ``kept`` and ``failed_rules`` (names of
    the table's rules that a row breaks) to every row. ``stop_words`` takes the
    place of ``STOP_WORDS`` and ``FURTHER_WORDS``."""
    words = sorted({w for ws in (stop_words or STOP_WORDS).values() for w in ws})
    own = docs.columns
    d = _counts(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{text}`").alias("_text")), "_text")
    further = [] if stop_words else sorted({w for ws in FURTHER_WORDS.values() for w in ws} - set(words))
    metrics = _metrics(words)
    base = ((F.col("n_words") < min_words)
            | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    broken = []
    for r in rules:
        value = metrics[r.metric]
        out = F.lit(False)
        if r.low is not None:
            below = value < r.low
            if r.metric == "stop_ratio":
                below = below & ~_spared(words, further, r.low)
            out = out | below
        if r.high is not None:
            out = out | (value > r.high)
        broken.append(F.when(out, F.lit(r.metric)))
    d = (d.withColumn("base_failed", base)
         .withColumn("failed_rules", F.array_compact(F.array(*broken)))
         .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "failed_rules", "kept"]
    # One value per row through a generator: filters on the results then stay above
    # it, where they cost nothing, and are not unfolded into the expressions below.
    result = F.explode_outer(F.array(F.struct(*added))).alias("_v")
    others = [F.col("_row").getField(c).alias(c) for c in own if c not in added]
    return d.select("_row", result).select(*others, "_v.*")


def keep_good(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows that the table keeps, with the columns they came with."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col(f"`{text}`").alias("_text"))
    return judge(whole, "_text", **options).where("kept").select("_row.*")
