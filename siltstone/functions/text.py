"""Text as Column expressions: normal forms, words, numbers, answer metrics, markup. No Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about content, and the reply that counts as abstaining.
STOPWORDS = (
    "the a an of to in and or for on at by is are was were be been being with as "
    "that this it its from which who whom whose what when where how"
).split()
ABSTAIN = "not stated in the context"
QUOTE_OPEN, QUOTE_CLOSE = "##begin_quote##", "##end_quote##"

STRINGS = "array<string>"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def norm(c: Column) -> Column:
    """White space to single blanks, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " ")))


def not_blank(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def bound(c: Column, f) -> Column:
    """f(c) with c worked out once: in a lambda of f, an expression in place of a value would be worked out for every element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def tokens(c: Column) -> Column:
    """Words between white space, as they are."""
    return not_blank(F.split(text_or_empty(c), r"(?U)\s+"))


def norm_tokens(c: Column) -> Column:
    return not_blank(F.split(norm(c), " "))


def words_alnum(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return not_blank(F.split(F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}\s]", " "), r"(?U)\s+"))


def content_words(c: Column) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    w = F.split(F.translate(norm(c), ",.", "  "), " +")
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(*STOPWORDS)))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by blanks; none if there are fewer."""

    def runs(w: Column) -> Column:
        last = F.size(w) - n + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(last >= 1, grams).otherwise(F.array().cast(STRINGS))

    return bound(words, runs)


def windows(words: Column, size: int) -> Column:
    """Words cut into windows of `size`; the last may be shorter."""

    def cut(w: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(w, i + 1, size))
        return F.when(F.size(w) > 0, parts).otherwise(F.array().cast("array<array<string>>"))

    return bound(words, cut)


def counted(words: Column) -> Column:
    """Distinct words with their counts, from one sort: an array of (word, n)."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (n > 0) & ((i == 1) | (F.element_at(w, F.greatest(i - 1, F.lit(1))) != F.element_at(w, i))))

        def lengths(first: Column) -> Column:
            ends = F.concat(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), F.array(n + 1))
            return F.zip_with(first, ends, lambda a, b: F.struct(F.element_at(w, a).alias("word"), (b - a).alias("n")))

        return F.when(n > 0, bound(starts, lengths)).otherwise(F.array().cast("array<struct<word:string,n:int>>"))

    return bound(F.array_sort(words), runs)


def overlap(pred: Column, ref: Column) -> Column:
    """Size of the multiset intersection of two word lists."""
    shared = lambda r: F.aggregate(counted(pred), F.lit(0), lambda acc, x: acc + F.least(x["n"], F.coalesce(F.try_element_at(r, x["word"]), F.lit(0))))
    return bound(F.map_from_entries(counted(ref)), shared)


def token_f1(pred: Column, ref: Column) -> Column:
    """Harmonic mean of precision and recall over word multisets; 0 if either text has no words or none is shared."""

    def of(x: Column) -> Column:
        both, p, r = x["both"], x["p"], x["r"]
        return F.when((p > 0) & (r > 0) & (both > 0), 2 * (both / p) * (both / r) / (both / p + both / r)).otherwise(F.lit(0.0))

    def sized(x: Column) -> Column:
        p, r = x["p"], x["r"]
        return bound(F.struct(overlap(p, r).cast("double").alias("both"), F.size(p).alias("p"), F.size(r).alias("r")), of)

    return bound(F.struct(words_alnum(pred).alias("p"), words_alnum(ref).alias("r")), sized)


def exact_match(pred: Column, ref: Column) -> Column:
    return (F.array_join(words_alnum(pred), " ") == F.array_join(words_alnum(ref), " ")).cast("double")


def norm_num(c: Column) -> Column:
    """Without thousands commas, a closing percent sign and a closing point."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), "%+$", ""), r"\.+$", "")


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(r"\d[\d,\.]*"), F.lit(0)), norm_num)


def fabrication(pred: Column, ctx: Column) -> Column:
    """1 if a number of pred is neither a number of ctx nor part of its text, else 0."""
    unknown = lambda c: F.exists(numbers(pred), lambda x: (x != "") & ~F.array_contains(c["known"], x) & (F.instr(c["whole"], x) == 0))
    return bound(F.struct(numbers(ctx).alias("known"), norm_num(text_or_empty(ctx)).alias("whole")), unknown).cast("double")


def abstains(c: Column) -> Column:
    return F.contains(F.lower(text_or_empty(c)), F.lit(ABSTAIN))


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def quote_ok(quote: Column, passage: Column) -> Column:
    return F.instr(norm(passage), norm(quote)) > 0


def after_last(c: Column, mark: str) -> Column:
    """What follows the last `mark`, trimmed; the whole text if there is none."""
    return F.trim(F.substring_index(text_or_empty(c), mark, -1))


def before_last(c: Column, mark: str) -> Column:
    t = text_or_empty(c)
    return F.when(F.instr(t, mark) > 0, F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, mark, -1)) - len(mark))).otherwise(F.lit(""))


def human_count(n: Column) -> Column:
    return (
        F.when(n >= 1e9, F.format_string("%.1fB", n / 1e9)).when(n >= 1e6, F.format_string("%.1fM", n / 1e6))
        .when(n >= 1e3, F.format_string("%.0fK", n / 1e3)).otherwise(F.format_string("%.0f", n.cast("double")))
    )


def clean_response(c: Column, most: int = 230) -> Column:
    """Quote markers as quotation marks, other markers gone, single blanks, cut at a word border; empty ones named."""
    t = F.replace(F.replace(text_or_empty(c), F.lit(QUOTE_OPEN), F.lit("“")), F.lit(QUOTE_CLOSE), F.lit("”"))
    t = F.regexp_replace(t, r"##[A-Za-z_]*quote[A-Za-z_]*##", "")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    cut = F.concat(F.regexp_replace(F.substring(t, 1, most), r"\s\S*$", ""), F.lit(" …"))
    return F.when(t == "", F.lit("(empty answer)")).when(F.length(t) > most, cut).otherwise(t)


def escaped(c: Column) -> Column:
    """HTML-safe text."""
    t = text_or_empty(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def clean_terms(c: Column, terms: dict[str, str]) -> Column:
    """Terms replaced one after the other, as they stand."""
    t = text_or_empty(c)
    for a, b in terms.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def bold_html(c: Column) -> Column:
    return F.regexp_replace(c, r"\*\*(.+?)\*\*", "<strong>$1</strong>")


def clamp(c: Column, most: int) -> Column:
    """An integer within 0 .. most; 0 for what is no number."""
    return F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(c.cast("int"), F.lit(0))))


def gradeable(c: Column) -> Column:
    """Whether an answer is worth a grader's time: not one letter over and over, some words or a short value.

    Control characters but tab and newline go, then blanks at both ends."""
    bare = F.regexp_replace(F.regexp_replace(text_or_empty(c), r"[\x00-\x08\x0b-\x1f]", ""), r"(?U)^\s+|\s+$", "")

    def worth(t: Column) -> Column:
        # t is a bound value here: the clean text is made once, not again for each of its letters.
        most = F.array_max(F.transform(F.array_distinct(F.split(t, "")), lambda x: F.length(t) - F.length(F.replace(t, x, F.lit("")))))
        words = F.size(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z]{2,}"), F.lit(0)), F.lower)))
        return (F.length(t) >= 2) & (F.coalesce(most, F.lit(0)) <= F.length(t) * 0.5) & ((words >= 3) | ((F.length(t) <= 50) & t.rlike("[A-Za-z0-9]")))

    return bound(bare, worth)


def hash_order(seed: int, *keys: Column) -> Column:
    """A portable pseudorandom order: the first eight hex digits of md5(seed|key...) as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("long")
