"""Keys and scalar text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def basename(path: Column) -> Column:
    """The part after the last slash of the trimmed path; a backslash doesn't divide."""
    return F.substring_index(F.trim(path), "/", -1)


def basename_lower(path: Column) -> Column:
    return F.lower(F.trim(F.substring_index(path, "/", -1)))


def norm_path(path: Column) -> Column:
    """Backslashes become slashes; empty and `.` parts go. `..` stays, as the text alone can't resolve links."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, "/+", "/")
    p = F.regexp_replace(p, r"(?<=^|/)\./", "")
    return F.regexp_replace(p, r"(?<=.)/\.?$", "")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def dir_segments(path: Column) -> Column:
    """Segments without the last one where that has a dot, and so is a file."""
    s = segments(path)
    return F.when(F.get(s, F.size(s) - 1).contains("."), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)


def group_key(path: Column, top: int | None = None, tail: int | None = None) -> Column:
    """The whole folder, its first `top` parts, or its last `tail` parts (0: all of them)."""
    s = dir_segments(path)
    if top is not None:
        s = F.slice(s, 1, top) if top > 0 else F.slice(s, 1, 0)
    elif tail:
        s = F.slice(s, F.greatest(F.size(s) - tail + 1, F.lit(1)), F.lit(tail))
    return F.array_join(s, "/")


def folder_after(path: Column, markers: list[str]) -> Column:
    """The part after the first marker folder that occurs, else the parent folder."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    found = [F.when(F.array_contains(parts, m), F.get(parts, F.array_position(parts, m).cast("int"))) for m in markers]
    return F.coalesce(*found, F.get(parts, F.size(parts) - 2))


def stem(path: Column) -> Column:
    """The file name without its extension; a leading dot begins no extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]*)$", 1)


def slugify(name: Column, joiner: str = "-", default: str | None = "chart") -> Column:
    s = F.regexp_replace(F.trim(name), "[^a-zA-Z0-9._-]+", joiner)
    s = F.trim(s, F.lit(joiner)) if joiner == "-" else s
    return F.coalesce(none_if_empty(s), F.lit(default)) if default is not None else s


def ascii_filter(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def row_by_row(returns: T.DataType):
    """A plain Python function as a Column function; for long texts.

    Its rows go to Python a hundred at a time, whereas an Arrow batch has 10,000
    rows whatever their length: so a worker's memory doesn't grow with the table.
    """
    return F.udf(returnType=returns, useArrow=False)


@row_by_row(T.StringType())
def ascii_fold(text):
    """NFKD without what isn't ASCII then; trimmed."""
    return None if text is None else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii").strip()


@row_by_row(T.StringType())
def nfkc_spaces(text):
    """NFKC with white space runs as one space; trimmed."""
    return None if text is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()


def number_after_dash(link: Column) -> Column:
    """The number after the first dash that digits and then no digits follow up to the end or not."""
    return none_if_empty(F.regexp_extract(link, r"-([0-9]+)(?:$|[^0-9]*)", 1))


def number_before_image(path: Column) -> Column:
    return none_if_empty(F.regexp_extract(path, r"(?i)-([0-9]+)[.](?:jpg|png)$", 1))


def book_page(path: Column) -> Column:
    """(book, page) of names like .<book>_page<page>.png, which begin with the dot."""
    pattern = r"^\.([0-9]+)_page([0-9]+)\.png$"
    return F.struct(none_if_empty(F.regexp_extract(path, pattern, 1)).alias("book"), none_if_empty(F.regexp_extract(path, pattern, 2)).alias("page"))


def prefix_before_underscore(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def answer_key(text: Column) -> Column:
    """Lower case without punctuation at the end: equal keys are equal answers."""
    return F.rtrim(F.lower(text), F.lit(PUNCTUATION))


def yes_no_other(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v == "yes", "yes").when(v == "no", "no").otherwise("other")


def to_number(text: Column) -> Column:
    """A number without thousands separators and percent signs, null if it is none."""
    return F.translate(text, ",%", "").try_cast("double")


def fraction(value: Column) -> Column:
    return F.when(value <= 1.0000001, value).otherwise(value / 100)


def crop_words(text: Column, words: int = 20, more: int = 8) -> Column:
    """The first words, and up to `more` further ones, to the first point among them."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    tail = F.array_join(F.slice(w, words + 1, more), " ")
    cut = F.when(F.instr(tail, ".") == 0, tail).otherwise(F.concat(F.substring_index(tail, ".", 1), F.lit(".")))
    return F.when(F.size(w) <= words, text).otherwise(F.concat(F.array_join(F.slice(w, 1, words), " "), F.lit(" "), cut))


def title_of(path: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(stem(path), r"[_\-]+", " ")))


def more_words_than(text: Column, n: int = 3) -> Column:
    t = F.trim(text)
    return F.when(t == "", F.lit(False)).otherwise(F.size(F.split(t, r"\s+")) > n)


def segment_words(vocabulary: list[str]):
    """A function that cuts a name into words of the vocabulary, the longest first, title-cased; what fits none stays letter by letter joined."""
    words = sorted({w.lower() for w in vocabulary if w}, key=lambda w: (-len(w), w))

    @row_by_row(T.StringType())
    def cut(name):
        if name is None:
            return None
        rest, out, loose = name.lower(), [], ""
        while rest:
            hit = next((w for w in words if rest.startswith(w)), None)
            if hit:
                if loose:
                    out.append(loose)
                    loose = ""
                out.append(hit)
                rest = rest[len(hit) :]
            else:
                loose, rest = loose + rest[0], rest[1:]
        return " ".join(w.title() for w in out + ([loose] if loose else []))

    return cut


def prefix_case(name: Column) -> Column:
    """(kind, prefix) of image names of three known shapes; nulls for others."""
    kinds = [("chartqa", r"^(chartqa_csv_file_\d+)"), ("img", r"^(img\d+)"), ("imgD", r"^(imgD_\w+)")]
    kind, prefix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern in reversed(kinds):
        kind = F.when(name.rlike(pattern), F.lit(k)).otherwise(kind)
        prefix = F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(prefix)
    return F.struct(kind.alias("kind"), prefix.alias("prefix"))


def stable_seed(key: Column) -> Column:
    """The first 64 bits of the SHA-256 modulo 2^32 - 1."""
    return (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(4294967295).cast("decimal(20,0)")).cast("long")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def is_expired(updated: Column, seconds: Column, now: Column, margin: int = 60) -> Column:
    """Whether less than the margin is left, or the time can't be read."""
    end = F.unix_timestamp(F.try_to_timestamp(updated)) + seconds
    return F.coalesce(end - F.unix_timestamp(now) < margin, F.lit(True))


def suffixes(name: Column, mark: str = "_") -> Column:
    """Every suffix of the name that begins after a mark, the whole name first."""
    t = F.split(name, mark)
    return F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.array_join(F.slice(t, i, F.size(t) - i + 1), mark))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x1, y1, x2, y2]."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
