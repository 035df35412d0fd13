"""Column functions over text, names and numbers; all stay in the JVM.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that Python's str.strip removes (fixed values), as a character class.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DASH = "—"
#: Statuses after which the same request may succeed later (fixed values).
TRANSIENT = frozenset({408, 429, 500, 502, 503, 504, 529})


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_safe(text) -> Column:
    """Null as the empty text."""
    return F.coalesce(col(text), F.lit(""))


def strip(text) -> Column:
    """Without whitespace of any kind at the edges, NBSP and the separators U+001C to U+001F included."""
    return F.regexp_replace(col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


def cap(text, most: int | None) -> Column:
    """The first most code points; None is no cap."""
    return col(text) if most is None else F.substring(col(text), 1, most)


def doc_digest(text) -> Column:
    """The first 24 hex digits of sha256."""
    return F.substring(F.sha2(col(text), 256), 1, 24)


def chunk_digest(text) -> Column:
    return F.sha2(col(text), 256)


def n_words(text) -> Column:
    """The number of runs without whitespace of any kind; null counts 0."""
    return F.size(words(null_safe(text)))


def words(text) -> Column:
    return F.filter(F.split(col(text), f"[{SPACE}]+"), lambda w: w != "")


def first_words(text, most: int) -> Column:
    """A text of more than most words as its first ones joined by single spaces, any other as it is."""
    return F.when(n_words(text) > most, F.array_join(F.slice(words(text), 1, most), " ")).otherwise(col(text))


def model_slug(model) -> Column:
    return F.translate(col(model), "/:", "__")


def short_model(model) -> Column:
    """Without the publisher and the word embedding: qwen/qwen3-embedding-8b is qwen3-8b; other slashes become dashes."""
    return F.replace(F.regexp_replace(col(model), r"^qwen/qwen3-embedding-", "qwen3-"), F.lit("/"), F.lit("-"))


def background_name(model, prefix: str, dim) -> Column:
    return F.concat(F.replace(short_model(model), F.lit("-"), F.lit("_")), F.lit(f"_{prefix}_mrl"), F.col(dim).cast("string") if isinstance(dim, str) else F.lit(str(dim)))


def csv_options(text) -> Column:
    """The trimmed entries of a list with commas without the empty ones; none at all gives null."""
    found = F.filter(F.transform(F.split(col(text), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, found)


def falsy_coalesce(*columns) -> Column:
    """The first that is neither null nor 0 nor empty, else the last as it is."""
    *first, last = (col(c) for c in columns)
    return F.coalesce(*[F.when(~c.cast("string").isin("", "0", "0.0"), c) for c in first], last)


def size_text(n) -> Column:
    """Bytes as B, KB, MB or GB without decimals or TB with one; null and 0 give a dash."""
    n = col(n).cast("double")
    out = F.format_string("%.1f TB", n / 1024**4)
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(F.rint(n / 1024**power).cast("long").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return F.when(F.coalesce(n, F.lit(0.0)) == 0, F.lit(DASH)).otherwise(out)


def time_text(s) -> Column:
    """An ISO time as minutes, as written; what is none as its first 16 characters; null and empty give a dash."""
    s = col(s)
    iso = s.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:?\d\d)?)?$")
    bare = F.regexp_replace(F.regexp_replace(s, r"(Z|[+-]\d\d:?\d\d)$", ""), "T", " ")
    day = s.rlike(r"^\d{4}-\d\d-\d\d$")
    text = F.date_format(F.try_to_timestamp(F.when(day, s).otherwise(bare)), "yyyy-MM-dd HH:mm")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(DASH)).otherwise(F.coalesce(F.when(iso, text), F.substring(s, 1, 16)))


def cap_text(n) -> Column:
    return F.when(F.coalesce(col(n), F.lit(0)) == 0, F.lit("no cap")).otherwise(F.concat(col(n).cast("string"), F.lit(" chars")))


def number_text(n, form: str) -> Column:
    """By a format of printf, or with grouped thousands for ",d"; null gives a dash."""
    n = col(n)
    out = F.format_number(n.cast("long"), 0) if form == ",d" else F.format_string(form, n.cast("double"))
    return F.when(n.isNull(), F.lit(DASH)).otherwise(out)


def http_status(status, body) -> Column:
    """What a response counts as: its status; 200 without data the code within its error if that is transient, else 400."""
    body = col(body)
    told = F.coalesce(F.get_json_object(body, "$.error.code"), F.get_json_object(body, "$.code"))
    inner = F.trim(told).try_cast("int")
    mapped = F.when(inner.isin(*sorted(TRANSIENT)), inner).otherwise(F.lit(400))
    return F.when((col(status) == 200) & F.get_json_object(body, "$.data").isNull(), mapped).otherwise(col(status))
