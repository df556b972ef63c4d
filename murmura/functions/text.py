"""Text functions as Column expressions: tokens, scripts, guards, formats.  No Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the base script, and of the script that counts as the other one; parameters of most functions here.
BASE, OTHER = "[A-Za-z]", "[À-ÖØ-öø-ɏ]"


def tokens(text: Column) -> Column:
    """The text's tokens: what stands between Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def dense_chars(text: Column) -> Column:
    """Characters that are no white space."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""))


def squeeze(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def letters(text: Column, script: str) -> Column:
    """How many characters are of a class: what is missing once its runs are cut out, without an array of matches."""
    text = F.coalesce(text, F.lit(""))
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"(?:{script})+", ""))


def script_profile(text: Column, allowed: str = BASE) -> tuple[Column, Column]:
    """Letters inside and outside of the allowed script; marks, digits and punctuation are neutral."""
    inside = letters(text, allowed)
    return inside, letters(text, r"\p{L}") - inside


def dominant_language(text: Column, scripts: dict[str, str], default: str) -> Column:
    """The language with the most letters; another than ``default`` wins a tie, none if there are no letters.

    ``scripts`` goes from language to character class, ``default`` included.
    """
    counts = {k: letters(text, v) for k, v in scripts.items()}
    out = F.when(sum(counts.values(), F.lit(0)) == 0, F.lit(None).cast("string"))
    for k in scripts:
        if k != default:
            out = out.when((counts[k] > 0) & (counts[k] >= counts[default]), k)
    return out.otherwise(F.lit(default))


def strip_foreign(text: Column, allowed: str = BASE, share: float = 0.5) -> Column:
    """The tokens without letters, or with a foreign share of at most ``share``, with one space between them."""

    def keep(t: Column) -> Column:
        return letters(t, allowed) >= (1 - share) * letters(t, r"\p{L}")

    # Most texts have no foreign letter at all, and nothing to look at token by token.
    return F.when(script_profile(text, allowed)[1] == 0, F.array_join(tokens(text), " ")).otherwise(F.array_join(F.filter(tokens(text), keep), " "))


def foreign_share(text: Column, allowed: str = BASE) -> Column:
    inside, outside = script_profile(text, allowed)
    return F.when(inside + outside == 0, 0.0).otherwise(outside / (inside + outside))


def fold_case(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def run_key(token: Column) -> Column:
    """A token without the punctuation around it, in one case."""
    return fold_case(F.btrim(token, F.lit(".,!?…:;")))


def longest_run(toks: Column) -> Column:
    """The longest run of one token; a token of punctuation only never extends a run."""
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"), F.lit("").alias("last"))

    def step(acc: Column, key: Column) -> Column:
        run = F.when((key != "") & (key == acc["last"]), acc["run"] + 1).when(key != "", 1).otherwise(0)
        return F.struct(F.greatest(acc["best"], run).alias("best"), run.alias("run"), key.alias("last"))

    # Keys are an array of their own: a lambda computes what it names as often as it names it.
    return F.aggregate(F.transform(toks, run_key), start, step, lambda acc: acc["best"])


def ngrams(toks: Column, n: int = 3) -> Column:
    """All runs of ``n`` tokens, each joined by a space.

    The array is zipped with itself moved on; a lambda that looked into ``toks`` would compute it for every element.
    """
    out = toks
    for k in range(1, n):
        out = F.zip_with(out, F.slice(toks, k + 1, F.lit(1 << 30)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda g: g.isNotNull())


def most_frequent(items: Column) -> Column:
    """How often the most frequent item stands in an array: the longest run after sorting."""
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"), F.lit(None).cast("string").alias("last"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(t.eqNullSafe(acc["last"]), acc["run"] + 1).otherwise(1)
        return F.struct(F.greatest(acc["best"], run).alias("best"), run.alias("run"), t.alias("last"))

    return F.aggregate(F.sort_array(items), start, step, lambda acc: acc["best"])


def with_echo(df: DataFrame, text: str, context: str, least: int = 5, share: float = 0.8) -> DataFrame:
    """Adds echo_share and echo as ``guards.echoed`` does: the 3-grams that a text shares with its context, in one Arrow pass."""
    from murmura.functions import guards

    return guards.echoed(df, text, context, guards.Guard(echo_tokens=least, echo=share))


def clock(seconds: Column) -> Column:
    """``m:ss``, seconds cut off."""
    whole = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


def seconds(value: Column) -> Column:
    """``1.5`` or ``1.500s`` as a number, else null."""
    return F.regexp_replace(F.trim(value), "s$", "").try_cast("double")


def tenths(value: Column) -> Column:
    """A number with one decimal as C's printf rounds it: by its exact binary value, half to even.

    ``format_string`` rounds the shortest decimal of a double instead: 29.15, which is a little less, gives 29.2 there and 29.1 here.
    """
    size = F.abs(value)
    ten = size * 8 + size * 2
    lost = size * 2 - (ten - size * 8)  # exact, since the larger part is taken off first
    whole = F.floor(ten)
    over = ten - whole.cast("double") - 0.5
    up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    n = whole + up.cast("long")
    return F.concat(F.when(value < 0, "-").otherwise(""), ((n - n % 10) / 10).cast("long").cast("string"), F.lit("."), (n % 10).cast("string"))
