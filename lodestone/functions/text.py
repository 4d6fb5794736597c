"""Column expressions over text and commit rows; all of them built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "Files: "
TEXT_LIMIT = 10_000
PATHS_LIMIT = 2_000

#: Boundaries inside an identifier: before an upper-case letter that follows
#: another kind of character, before the last capital of a run of them, and
#: between letters and digits.
_HUMPS = (
    r"(?<=\P{IsUppercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
    r"|(?<=\p{IsAlphabetic})(?=\p{N})|(?<=\p{N})(?=\p{IsAlphabetic})"
)
#: Next to a boundary is one of these. Few characters are capitals or digits, so only
#: they are looked around at.
_SOME_HUMP = (
    r"[\p{IsUppercase}\p{N}](?:(?<=[\p{IsAlphabetic}\p{N}&&\P{IsUppercase}]\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
    r"|(?<=\p{IsAlphabetic}\p{N})|(?<=\p{N})(?=\p{IsAlphabetic}))"
)


def split_identifier(word: Column) -> Column:
    """The humps of an identifier, in lower case."""
    return F.transform(F.split(word, _HUMPS), F.lower)


def tokenize(text: Column) -> Column:
    """Lower-case words of 2 to 40 bytes; words with humps or digits are followed
    by their parts of at least two bytes."""

    def expand(w: Column) -> Column:
        plain = (F.substr(w, F.lit(2)) == F.lower(F.substr(w, F.lit(2)))) & ~F.rlike(w, F.lit(r"\p{N}"))
        whole = F.array(F.lower(w))
        parts = F.filter(split_identifier(w), lambda p: (F.octet_length(p) >= 2) & (p != F.lower(w)))
        return F.when(~F.rlike(w, F.lit(_SOME_HUMP)) | plain, whole).otherwise(F.concat(whole, parts))

    words = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: F.octet_length(w).between(2, 40))
    # Most texts have no such word, and then no word is looked at by itself.
    return F.when(F.rlike(text, F.lit(_SOME_HUMP)), F.flatten(F.transform(words, expand))).otherwise(F.transform(words, F.lower))


def doc_text(message: Column, author: Column, diff: Column, include_diff: bool = True) -> Column:
    """The indexed text: message, author, and the diff if wanted and not empty."""
    parts = [message, author]
    if include_diff:
        parts.append(F.when(diff != "", diff))
    return F.concat_ws("\n", *parts)


def changed_files(diff: Column) -> Column:
    """Paths of the ``Files:`` line, or null where there is none."""
    line = F.regexp_replace(F.split_part(diff, F.lit("\n"), F.lit(1)), "\r$", "")
    paths = F.transform(F.split(F.substr(line, F.lit(len(FILES) + 1)), ", "), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.when(F.startswith(line, F.lit(FILES)), F.filter(paths, lambda p: (p != "") & (p != "...")))


def touches_path(diff: Column, needle: str) -> Column:
    """Some changed path holds the needle; without a ``Files:`` line, the diff."""
    n = F.lit(needle)
    return F.coalesce(F.exists(changed_files(diff), lambda p: F.contains(p, n)), F.contains(diff, n))


def changed_paths(old: Column, new: Column, limit: int = PATHS_LIMIT) -> Column:
    """The ``Files:`` line: distinct paths in order, as many as fit the limit in
    bytes, and ``, ...`` after them if some do not."""
    paths = F.array_sort(F.array_distinct(F.filter(F.concat(old, new), lambda p: p.isNotNull())))
    start = F.struct(F.lit(FILES).alias("line"), F.lit(False).alias("full"), F.lit(True).alias("first"))

    def add(acc: Column, path: Column) -> Column:
        longer = F.concat(acc["line"], F.when(acc["first"], F.lit("")).otherwise(F.lit(", ")), path)
        full = acc["full"] | (F.octet_length(longer) > limit)
        line = F.when(full, acc["line"]).otherwise(longer)
        return F.struct(line.alias("line"), full.alias("full"), (acc["first"] & full).alias("first"))

    return F.aggregate(paths, start, add, lambda acc: F.when(acc["full"], F.concat(acc["line"], F.lit(", ..."))).otherwise(acc["line"]))


def truncate_bytes(text: Column, limit: int = TEXT_LIMIT) -> Column:
    """The characters that start before byte ``limit``; a mark follows where the
    text is longer."""
    mark = F.lit("\n... (truncated)")
    # ASCII text is cut by characters; other text, by summing bytes per character.
    chars = F.split(text, "")
    start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars"))
    count = lambda acc, c: F.struct(
        (acc["bytes"] + F.octet_length(c)).cast("int").alias("bytes"),
        (acc["chars"] + F.when((acc["bytes"] < limit) & (c != ""), 1).otherwise(0)).cast("int").alias("chars"),
    )
    kept = F.aggregate(chars, start, count, lambda acc: acc["chars"])
    cut = F.when(F.octet_length(text) == F.char_length(text), F.left(text, F.lit(limit))).otherwise(F.substr(text, F.lit(1), kept))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, mark))


def patch_lines(patch: Column) -> Column:
    """Added and removed lines of a patch, without its file headers."""
    lines = F.filter(F.split(patch, "\n"), lambda x: F.rlike(x, F.lit(r"^[+-]")) & ~F.rlike(x, F.lit(r"^(\+\+\+|---)( |$)")))
    return F.array_join(lines, "\n")


def subject(message: Column) -> Column:
    return F.regexp_replace(F.split_part(message, F.lit("\n"), F.lit(1)), "\r$", "")


def trim_end(message: Column) -> Column:
    """Without white space of any kind at the end."""
    return F.regexp_replace(message, r"(?U)\s+$", "")


def short_hash(column: Column) -> Column:
    return F.left(column, F.lit(7))


def rfc3339(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'HH:mm:ssxxx")


def diff_preview(diff: Column, lines: int = 2) -> Column:
    return F.array_join(F.slice(F.split(diff, "\n"), 1, lines), "\n   ")
