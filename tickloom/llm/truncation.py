"""Texts cut off by a field limit or a broken transfer."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import fits_broadcast, written

BANDWIDTH = 10
FALSE_DISCOVERY = 0.01
SUPPORT = 3
# share of the texts with a tail that must stop at significant lengths before it, for the tail to be a cut mark
MARK_SHARE = 0.5
TRIMMED = 2

# white space, control characters and what stands for lost or invisible ones
BLANKS = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc")) + "�﻿​"
# what may be a mark after a cut: brackets, or dots and at most a few words after them; which of them are marks the lengths tell
TAIL = r"\s*(?:(?:…|\.{2,})[^.…\n\[\](){}<>]{0,40}|[\[(<{][^\[\](){}<>\n]{1,60}[\])>}])+\z"
CLOSERS = r"[\"'”’»)\]}]*"
ENDED = rf"[.!?。！？]{CLOSERS}\z"
# a sentence that ends inside the line, and words after it
INNER_END = r"[\p{L}\p{N}%)\"”’'][.!?][\"”’')\]]*\s+[\p{Lu}\p{N}\"“¿¡(]"
BULLET = r"^\s*(?:[-*•·–]|\d+[.)])\s+.*:\s*\S+\z"
FIGURES = r"^[\p{Lu}\p{N}\s.,/%:+\-()$€£|=]*\p{N}[\p{N}.,%)]*\z"
NOTE = r"^\s*(?:\([^()]*\)|\[[^\[\]]*\])\z"
LAST_WORD = r"(?s)^(?:.*[^\p{L}\p{N}'’\-])?['’\-]*([\p{L}\p{N}][\p{L}\p{N}'’\-]*)[^\p{L}\p{N}]*\z"
TOKEN = r"([\p{L}\p{N}][\p{L}\p{N}'’\-]*|\n|[^\s\p{L}\p{N}]+)"
MEASURES = ("chars", "body_chars", "octets")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def _endings(docs: DataFrame) -> DataFrame:
    """Each text's lengths, its tail (what may be a cut mark), and the last line as it stands and without the tail."""
    rows = docs.select("doc_id", "source", "text").where("text is not null").withColumn("stripped", F.rtrim("text", F.lit(BLANKS)))
    rows = rows.withColumn("line", F.ltrim(F.substring_index("stripped", "\n", -1), F.lit(BLANKS)))
    rows = rows.withColumn("tail", F.regexp_extract("line", TAIL, 0)).withColumn("has_tail", F.length("tail") > 0)
    bare = F.rtrim(F.substr("line", F.lit(1), F.length("line") - F.length("tail")), F.lit(BLANKS))
    rows = rows.withColumn("bare", F.when(F.col("has_tail") & (bare != ""), bare))
    form = F.regexp_replace(F.lower(F.trim("tail")), r"\p{N}+", "9")
    lengths = [F.length("text").alias("chars"), F.when(F.col("has_tail"), F.length("stripped") - F.length("tail")).otherwise(F.length("text")).alias("body_chars"), F.octet_length("text").alias("octets")]
    return rows.select("doc_id", "source", F.xxhash64("text").alias("hash"), *lengths, (F.col("stripped") == "").alias("blank"), F.when(F.col("has_tail"), form).alias("tail_form"), _ending("line").alias("whole"), F.when(F.col("bare").isNotNull(), _ending("bare")).alias("cut"))


def _ending(column: str) -> Column:
    """How a last line ends: flags by its form, the last word, and for a line of its own a digest of its whole form."""
    line = F.col(column)
    ended, item = line.rlike(ENDED), line.rlike(BULLET) | line.rlike(NOTE) | (line.rlike(FIGURES) & ~line.rlike(r"\p{Ll}{2}"))
    number = line.endswith(".") & line.rlike(r"(?:^|\s)\p{Ll}+ \d{1,4}\.\z")
    open_line = ~ended & ~item
    prose = F.when(open_line, line.rlike(INNER_END)).otherwise(False)
    alone = open_line & ~prose
    return F.struct(
        ended.alias("ended"), item.alias("item"), number.alias("open_number"), alone.alias("alone"),
        F.when(alone, F.md5(F.regexp_replace(F.lower(line), r"\d+", "9"))).alias("form"), F.when(alone, F.lower(F.regexp_extract(line, LAST_WORD, 1))).alias("word"),
    )


def length_hazards(endings: DataFrame, bandwidth: int = BANDWIDTH, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """(source, measure, length, n, at_risk, expected, log_p, significant) for each length at which texts of a source end.

    The hazard of a length is n / at_risk: the share of the source's different texts at least that long that end there. It is held against
    the pooled hazard of the other lengths within bandwidth on both sides, their ends over their exposure: each of those lengths counts with the texts
    that reached it, so lengths that nobody could reach weigh nothing and lengths without an end weigh in full. expected is at_risk times the pooled
    hazard (half an end added); log_p bounds the binomial tail of n among at_risk from above (Chernoff), and per source and measure the false
    discovery rate is kept (Benjamini-Hochberg over all lengths up to the longest). A length whose neighbours nobody reached is not tested. Measures: characters,
    characters before a possible cut mark, UTF-8 octets. Equal texts count once, so reposts make no peak.
    """
    once = endings.groupBy("source", "hash").agg(*[F.min(m).alias(m) for m in MEASURES])
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("length")) for m in MEASURES])).alias("m")
    counts = once.select("source", measures).groupBy("source", "m.measure", "m.length").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("source", "measure")
    by = every.orderBy("length")
    near, upto = by.rangeBetween(-bandwidth, bandwidth), by.rangeBetween(Window.unboundedPreceding, bandwidth)
    total = F.sum("n").over(every)
    sums = counts.withColumns({
        "at_risk": total - F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n"), "beyond": total - F.sum("n").over(upto),
        "_n": F.sum("n").over(near), "_nl": F.sum(F.col("n") * F.col("length")).over(near), "tests": F.greatest(F.max("length").over(every), F.lit(1)),
    })
    first = F.greatest(F.col("length") - bandwidth, F.lit(0))
    # exposure of the band: a text counts once for each of the band's lengths that it reached
    exposure = F.col("beyond") * (F.col("length") + bandwidth - first + 1) + F.col("_nl") - (first - 1) * F.col("_n") - F.col("at_risk")
    hazard = F.when(exposure > 0, F.least((F.col("_n") - F.col("n") + 0.5) / exposure, F.lit(1 - 1e-9)))
    rated = sums.withColumn("_h", hazard).withColumn("expected", F.col("at_risk") * F.col("_h"))
    n, r = F.col("n").cast("double"), F.col("at_risk").cast("double")
    rest = F.when(n < r, (r - n) * F.log((r - n) / (r * (1 - F.col("_h"))))).otherwise(0.0)
    rated = rated.withColumn("log_p", F.when(n > F.col("expected"), -(n * F.log(n / F.col("expected")) + rest)).otherwise(0.0))
    ranked = rated.withColumn("k", F.row_number().over(every.orderBy("log_p", "length")))
    last = F.max(F.when(F.col("log_p") <= F.log(false_discovery * F.col("k") / F.col("tests")), F.col("k"))).over(every)
    return ranked.withColumn("significant", F.coalesce(F.col("k") <= last, F.lit(False)) & (F.col("n") >= SUPPORT)).select("source", "measure", "length", "n", "at_risk", "expected", "log_p", "significant")


def _at_peaks(endings: DataFrame, hazards: DataFrame) -> DataFrame:
    """endings with the significant lengths each text has (at_*), and whether its body stops at one or was trimmed just short of it (near_body)."""
    peaks = written(hazards.where("significant").select("source", "measure", "length"))
    at = endings
    for m, reach in (*((m, 0) for m in MEASURES), ("body_chars", TRIMMED)):
        name = f"at_{m}" if not reach else "near_body"
        of = peaks.where(F.col("measure") == m).select(F.col("source").alias("_s"), F.explode(F.sequence(F.col("length") - reach, F.col("length"))).alias("_l")).distinct().withColumn(name, F.lit(True))
        at = at.join(_small(of), F.col("source").eqNullSafe(F.col("_s")) & (F.col(m) == F.col("_l")), "left").drop("_s", "_l").withColumn(name, F.coalesce(name, F.lit(False)))
    return at


def cut_marks(at: DataFrame, share: float = MARK_SHARE) -> DataFrame:
    """The tails that mark a cut: those forms (digits aside) whose different texts stop at significant lengths, with the tail or before it, in at least `share` of the cases and
    SUPPORT times. A tail that follows texts of any length, such as an editor's note, is none."""
    there = F.col("at_chars") | F.col("at_octets") | F.col("near_body")
    forms = at.where("tail_form is not null").groupBy("tail_form", "hash").agg(F.max(there.cast("int")).alias("there"))
    return forms.groupBy("tail_form").agg(F.sum("there").alias("m"), F.count(F.lit(1)).alias("n")).where((F.col("m") >= SUPPORT) & (F.col("m") >= share * F.col("n"))).select("tail_form")


def _words(docs: DataFrame) -> DataFrame:
    """(word, seen, ends) over all texts: how often a word stands before something else, and how often that is a line's end."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(1))
    body = docs.where("text is not null").select(tokens.alias("t")).where(F.size("t") > 1)
    pairs = body.select(F.explode(F.transform(F.slice("t", F.lit(1), F.size("t") - 1), lambda w, i: F.struct(w.alias("word"), (F.get("t", i + 1) == "\n").alias("ends")))).alias("p")).select("p.*")
    return pairs.where(F.col("word").rlike(r"^[\p{L}\p{N}]")).groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.sum(F.col("ends").cast("long")).alias("ends"))


def _beginnings(asked: DataFrame, words: DataFrame) -> DataFrame:
    """The asked words that are the beginning of a longer one of `words`.

    In byte order the words that begin with a text follow right after it, so the next longer word tells; both are sorted by their first letters, and no word is
    taken apart however long it is.
    """
    known = words.select("word", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(3)))).alias("k"), F.lit(0).alias("asks"))
    rows = known.unionByName(asked.where("word <> ''").select("word", F.least(F.length("word"), F.lit(3)).alias("k"), F.lit(1).alias("asks")))
    w = Window.partitionBy("k", F.substring("word", F.lit(1), F.col("k"))).orderBy(F.desc("word"), F.desc("asks"))
    after = F.last(F.when(F.col("asks") == 0, F.col("word")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("after", after).where((F.col("asks") == 1) & F.col("after").startswith(F.col("word"))).select("word", F.lit(True).alias("prefix"))


def truncated(docs: DataFrame, bandwidth: int = BANDWIDTH, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """(doc_id, source, cut, reason, limit_length) for each text: whether it stops because the rest was lost.

    A text is at a limit if its length is significant among its source's lengths (length_hazards); a tail that stands after texts at such lengths is a
    cut mark (cut_marks). An ending is complete if, white space and cut marks aside, it ends with a sentence mark, is a list item, a row of figures or a
    note in brackets, or is a line of its own that stands at the end of texts or lines elsewhere: a sign-off by its whole form, a headline by its last word,
    counted over all different documents but never from texts at a limit; a beginning of a longer word that occurs nowhere else is a fragment and ends
    nothing. Incomplete endings are cut: reason limit at a significant length or before a cut mark, else transfer. A short number after a
    plain word with nothing behind its point counts as incomplete at a significant length or before a mark only. Texts cut right after a complete
    sentence, blank texts and null texts are not cut; null sources form one source.
    """
    endings = written(_endings(docs))
    at = _at_peaks(endings, length_hazards(endings, bandwidth, false_discovery))
    at = written(at.join(_small(cut_marks(at).withColumn("marked", F.lit(True))), "tail_form", "left").withColumn("marked", F.coalesce("marked", F.lit(False))))
    pick = lambda c: F.when(F.col("marked") & F.col("cut").isNotNull(), F.col(f"cut.{c}")).otherwise(F.col(f"whole.{c}")).alias(c)
    limit = F.col("at_chars") | F.col("at_octets") | F.col("at_body_chars")
    limit_length = F.when(F.col("at_body_chars"), F.col("body_chars")).when(F.col("at_chars"), F.col("chars")).when(F.col("at_octets"), F.col("octets"))
    at = at.select("doc_id", "source", "hash", "blank", "marked", limit.alias("limit"), limit_length.alias("limit_length"), *[pick(c) for c in ("ended", "item", "open_number", "alone", "form", "word")])

    # lines of their own without a sentence mark: their forms and last words, as endings and in running text
    lone = at.where("alone and not blank and not marked")
    forms = lone.where("not limit").select("form", "hash").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("form_n"))
    closing = lone.where("not limit").select("word", "hash").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("closing"))
    asked = lone.select("word").distinct()
    words = written(_words(docs))
    # a fragment: never seen inside a line, while a longer word that starts with it is
    known = asked.join(words, "word", "left").join(closing, "word", "left").join(_beginnings(asked, words.where("seen >= 2")), "word", "left").na.fill(0, ["seen", "ends", "closing"])
    inside = F.col("seen") - F.col("ends")
    finals = F.col("ends") + F.col("closing")
    fragment = (inside == 0) & (F.col("ends") == 0) & F.coalesce("prefix", F.lit(False))
    known = known.select("word", fragment.alias("fragment"), ((finals >= SUPPORT) & (finals >= inside) & ~fragment).alias("word_ends"))
    stands = forms.where(F.col("form_n") >= SUPPORT).select("form", F.lit(True).alias("stands"))
    full = at.join(_small(stands), "form", "left").join(_small(known), "word", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    whole = F.col("alone") & ~F.col("marked") & ((yes("stands") & ~yes("fragment")) | yes("word_ends"))
    complete = (F.col("ended") & ~(F.col("open_number") & (F.col("limit") | F.col("marked")))) | F.col("blank") | (~F.col("marked") & F.col("item")) | whole
    reason = F.when(~complete, F.when(F.col("limit") | F.col("marked"), "limit").otherwise("transfer"))
    return full.select("doc_id", "source", (~complete).alias("cut"), reason.alias("reason"), F.when(~complete, F.col("limit_length")).alias("limit_length"))


def by_source(judged: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, their share, and those by reason."""
    n = lambda c: F.sum(c.cast("long"))
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), n(F.col("cut")).alias("cut_texts"), (n(F.col("cut")) / F.count(F.lit(1))).alias("cut_share"),
        F.coalesce(n(F.col("reason") == "limit"), F.lit(0)).alias("at_limit"), F.coalesce(n(F.col("reason") == "transfer"), F.lit(0)).alias("in_transfer"),
    )
