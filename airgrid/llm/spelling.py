"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the common form each rare word goes back to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.session import cut_lineage

RUN = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LETTERS = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIPS = 31  # one occurrence in so many loses a letter
MOST_PAIRS = 256  # a key with more pairs than this is divided before it is joined
FORM_TIMES = 10


def vocabulary(documents: DataFrame, least: int = LEAST_LETTERS, least_n: int = 2, slips: int | None = SLIPS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: lower-cased (A-Z only) runs of letters of at least ``least`` code points with at least ``least_n`` occurrences.

    With ``slips`` the runs of a document are first damaged as typing does: where the crc32 of ``<doc_id>:<run>`` is a multiple
    of it, the letter at that crc32 modulo the run's length goes (a null id is spelled as an empty text). Null texts have no
    words. Occurrences are combined in each task before they are shuffled, so a common word costs a row per task.
    """
    # Only runs of at least the least length count, as slips only shorten them.
    runs = documents.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("_run"),
    ).select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    word = F.col("_run")
    if slips:
        h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
        at = (h % F.length("_run")).cast("int")
        word = F.when(h % slips == 0, F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))).otherwise(word)
    words = runs.select(word.alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def halves() -> Column:
    """The two chunks of the stretch ``lo`` .. ``hi`` of a word of ``chunked`` letters."""
    middle = F.expr("(lo + hi + 1) div 2")
    return F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))


def divided(posts: DataFrame) -> DataFrame:
    """Each posting twice: either half of its open stretch ``lo`` .. ``hi`` is taken as a further chunk that has to be equal.

    The key holds the parts outside the stretch that stays open: the grams before it counted from the start of the word and
    those behind it from its end, which is the shift by the difference of the two lengths.
    """
    two = posts.select("word", "n", "chunked", "is_chunk", F.explode(halves()).alias("_s")).select("word", "n", "chunked", "is_chunk", "_s.lo", "_s.hi").filter("lo < hi")
    behind = F.col("chunked") - F.col("hi")
    size = F.length("word")
    key = F.xxhash64("chunked", "lo", "hi", F.col("word").substr(F.lit(1), F.col("lo")), F.col("word").substr((size - behind + 1).cast("int"), behind))
    return two.withColumn("key", key)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: every two words of ``words`` (``word, n``) that differ by one inserted, deleted or replaced letter, once.

    The shorter word of a pair contributes its two halves as disjoint chunks, the other the grams of the same length that lie
    where a half can lie after one edit: at the start, or shifted by the difference in length, which is at most one. One edit
    leaves one of the halves whole, so every pair meets at a key. Where a half is shared by so many words that their pairs
    would exceed ``MOST_PAIRS``, its other half is divided again in the same way, until one letter is left open; then all words
    of a key differ in at most that letter. So the work per word is bounded, and no pair is dropped. Candidates are
    verified by a distance that stops at one. Words must be distinct and not null.
    """
    size = F.length("word")
    chunk = words.select("word", "n", size.alias("chunked"), F.lit(True).alias("is_chunk"))
    gram = words.select("word", "n", F.explode(F.array(size - 1, size)).alias("chunked"), F.lit(False).alias("is_chunk"))
    posts = chunk.unionByName(gram).withColumns({"lo": F.lit(0), "hi": F.col("chunked")})
    found = None
    while True:
        posts = cut_lineage(divided(posts))
        per_key = posts.groupBy("key").agg(F.count_if("is_chunk").alias("chunks"), F.count_if(~F.col("is_chunk")).alias("grams"), F.max(F.expr("hi - lo")).alias("open"))
        hot = cut_lineage(per_key.filter((F.col("chunks") * F.col("grams") > MOST_PAIRS) & (F.col("open") > 1)).select("key"))
        any_hot = not hot.isEmpty()
        cold = posts.join(hot, "key", "left_anti") if any_hot else posts
        left = cold.filter("is_chunk").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        right = cold.filter("NOT is_chunk").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
        # Words of equal length meet from either side; the smaller one is the chunked one.
        pairs = left.join(right, "key").filter("(length(a) < length(b) OR a < b) AND levenshtein(a, b, 1) = 1").select("a", "a_n", "b", "b_n")
        pairs = cut_lineage(pairs)
        found = pairs if found is None else found.unionByName(pairs)
        if not any_hot:
            return found.distinct()
        posts = posts.join(hot, "key", "left_semi").drop("key")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word of ``word, form``, the last of its forms. Forms grow by a factor, so chains are short; each
    round doubles the steps taken and is written to the shared folder. A form has as many variants as there are edits of a
    word, so no key is hot."""
    ahead = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        further = cut_lineage(ahead.join(step, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        ahead = further.drop("_moved")
        if further.filter("_moved").isEmpty():
            return ahead


def variants(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``words`` (``word, n``; distinct, not null).

    A word's form is its near word of the largest ``n`` (ties: the smallest in code-point order) if that is at least ``times``
    its own, else null. ``root`` follows the forms to the last; the word itself where there is none. An empty table gives an
    empty table.
    """
    words = cut_lineage(words)
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = cut_lineage(
        words.join(best, "word", "left").withColumn("_is", -F.col("best.less") >= times * F.col("n"))
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_is"), F.col("best.near")).alias("form"), F.when(F.col("_is"), -F.col("best.less")).alias("form_n"))
    )
    root = roots(judged.filter("form IS NOT NULL"))
    return judged.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(documents: DataFrame, least: int = LEAST_LETTERS, least_n: int = 2, slips: int | None = SLIPS, times: int = FORM_TIMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The vocabulary of whole ``documents`` with its variants grouped; see ``vocabulary`` and ``variants``.

    Null and empty texts have no words, repeated rows count each, other columns are not read.
    """
    return variants(vocabulary(documents, least, least_n, slips, doc_id, text), times)
