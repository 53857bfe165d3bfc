"""Words of texts that are written without spaces between them, by a dictionary learned from the texts.

*Dictionary.* Runs of Han characters give all their sequences of up to ``longest`` characters with
counts. A sequence is a word if it is frequent enough and holds together: wherever it is cut in two,
it occurs ``cohesion`` times as often as its parts would side by side by chance.

*Segmentation.* A run's word graph has an edge for every dictionary word at every place, and one for
each single character. The path of the greatest product of word probabilities is found from the
run's end. For search, the shorter dictionary words within a word of three characters or more come
before it. Everything else of a text is split at white space, as :func:`millrace.functions.text.tokens` does.

Runs meet the dictionary in a join on sequences, so neither has to fit a task; each distinct run is
segmented once, and its graph is as long as the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.tables import kept

HAN = r"\p{IsHan}+"
#: Runs of Han characters, and what stands between them and white space.
_PIECES = rf"{HAN}|[^\s\p{{IsHan}}]+"


def has_han(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{IsHan}"), F.lit(False))


def han_runs(texts: DataFrame, text: str = "text") -> DataFrame:
    """(run, n): the runs of Han characters of all texts, and how often each occurs."""
    return texts.where(has_han(F.col(text))).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(HAN), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def _sequences(longest: int) -> Column:
    """All (at, word) of a run's sequences of up to ``longest`` characters."""
    at = F.sequence(F.lit(1), F.length("run"))
    return F.explode(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - i + 1)), lambda n: F.struct(i.alias("at"), F.substr(F.col("run"), i, n).alias("word"))))))


def learn(runs: DataFrame, longest: int = 4, least: int = 5, cohesion: float = 10.0) -> DataFrame:
    """(word, n, log_p): single characters, and longer sequences that are frequent and hold together.

    ``runs`` (run, n). log_p is the logarithm of a word's share of the dictionary's counts."""
    found = runs.select("n", _sequences(longest).alias("s")).groupBy(F.col("s.word").alias("word")).agg(F.sum("n").alias("n"))
    counts = kept(found.where((F.length("word") == 1) | (F.col("n") >= least)), "sequences")
    total = counts.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # where a sequence is cut, each part is as frequent at least, so it is among the counts
    cuts = counts.where(F.length("word") > 1).withColumn("cut", F.explode(F.sequence(F.lit(1), F.length("word") - 1)))
    cuts = cuts.select("word", "n", F.expr("substr(word, 1, cut)").alias("head"), F.expr("substr(word, cut + 1)").alias("tail"))
    part = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    weakest = cuts.join(part("head"), "head").join(part("tail"), "tail").groupBy("word", "n").agg(F.max(F.col("n_head").cast("double") * F.col("n_tail")).alias("by_chance"))
    long_words = weakest.crossJoin(F.broadcast(total)).where(F.col("n") * F.col("total").cast("double") >= cohesion * F.col("by_chance")).select("word", "n")
    words = kept(counts.where(F.length("word") == 1).unionByName(long_words), "dictionary")
    whole = words.agg(F.sum("n").alias("whole"))
    return words.crossJoin(F.broadcast(whole)).select("word", "n", (F.log(F.col("n").cast("double")) - F.log(F.col("whole").cast("double"))).alias("log_p"))


def paths(runs: DataFrame, words: DataFrame, longest: int = 4) -> DataFrame:
    """(run, words): each distinct run's most probable words, in order, each preceded by the shorter
    dictionary words within it. A character that the dictionary lacks counts as seen once.

    Of equally probable paths the one whose first word is longer is taken."""
    rare = words.agg(F.coalesce(-F.log(F.sum("n").cast("double")), F.lit(0.0)).alias("rare"))
    runs = runs.select("run").distinct()
    places = runs.select("run", _sequences(longest).alias("s")).select("run", "s.at", "s.word")
    edges = places.join(words.select("word", "log_p"), "word").groupBy("run").agg(F.collect_list(F.struct("at", "word", "log_p")).alias("edges"))
    graphs = runs.join(edges, "run", "left").crossJoin(F.broadcast(rare)).select("run", F.coalesce("edges", F.expr("cast(array() as array<struct<at:int,word:string,log_p:double>>)")).alias("edges"), "rare")

    @F.udf("array<string>", useArrow=True)
    def best(run: str, edges: list, rare: float) -> list[str]:
        known = {(e["at"], len(e["word"])): e["log_p"] for e in edges}
        score, step = [0.0] * (len(run) + 2), [1] * (len(run) + 2)
        for i in range(len(run), 0, -1):
            ways = [(known.get((i, n), rare if n == 1 else None), n) for n in range(1, min(longest, len(run) - i + 1) + 1)]
            score[i], step[i] = max((p + score[i + n], n) for p, n in ways if p is not None)
        out, i = [], 1
        while i <= len(run):
            n = step[i]
            for short in range(2, n):
                out += [run[j - 1 : j - 1 + short] for j in range(i, i + n - short + 1) if (j, short) in known]
            out.append(run[i - 1 : i - 1 + n])
            i += n
        return out

    return graphs.select("run", best("run", "edges", "rare").alias("words"))


def segmented(texts: DataFrame, words: DataFrame, key: str, text: str = "text", longest: int = 4) -> DataFrame:
    """``texts`` with ``words``: the tokens of each text, lower-cased, in order.

    Texts without Han characters have the tokens of white space and take part in no join. Null and
    empty texts have none. ``key`` tells rows apart; rows of one key with Han characters are one text."""
    plain = texts.where(~has_han(F.col(text))).withColumn("words", tokens(F.col(text)))
    mixed = texts.where(has_han(F.col(text)))
    pieces = kept(mixed.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(_PIECES), F.lit(0))).alias("_no", "run")), "pieces")
    runs = pieces.where(has_han(F.col("run"))).select("run")
    by_run = kept(paths(runs, words, longest), "segmented")
    spelled = pieces.join(by_run, "run", "left").withColumn("words", F.coalesce("words", F.array("run")))
    whole = spelled.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_no", "words"))), lambda x: x["words"])).alias("words"))
    return plain.unionByName(mixed.join(whole, key))
