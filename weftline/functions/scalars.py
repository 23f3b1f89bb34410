"""Column functions: names, paths, hashes, flags, source ranges, exact integers."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of generated and internal names, access flags, the token pattern of sources.
GENERATED_NAME = r"(^_private\.|\._|\.rec(On)?$|\.casesOn$|\.noConfusion|\.inj(Eq)?$|\.ctorIdx$|\.sizeOf|\._sizeOf_)"
INTERNAL_NAME = r"(^_private\.|\._)"
ACC_STATIC, ACC_BRIDGE, ACC_NATIVE, ACC_ABSTRACT, ACC_SYNTHETIC = 0x0008, 0x0040, 0x0100, 0x0400, 0x1000
SOURCE_TOKEN = r"[A-Za-z_][A-Za-z0-9_']*|\p{Nd}+|[^\s\p{Z}\u001c-\u001f\u0085]"


def is_generated(name: Column) -> Column:
    """Names that a compiler makes."""
    return name.rlike(GENERATED_NAME)


def is_internal(name: Column) -> Column:
    """Private names, and names with a later part that starts with an underscore."""
    return name.rlike(INTERNAL_NAME)


def is_definition(kind: Column) -> Column:
    return kind.isin("definition", "opaque")


def has_flag(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def module_of(path: Column) -> Column:
    """``a/b/C.ext`` as ``a.b.C``."""
    return F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))


def domain_of(module: Column, root: str) -> Column:
    """The second part of a module under *root*, else the first."""
    parts = F.split(module, r"\.")
    return F.when((F.size(parts) > 1) & (F.get(parts, 0) == root), F.get(parts, 1)).otherwise(F.get(parts, 0))


def first_glob(path: Column, patterns: list[str], prefix: str = "") -> Column:
    """The first pattern (shell style, ``*`` crosses ``/``) that a path, or the path without *prefix*, matches; else null."""
    bare = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path) if prefix else path
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        rule = fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$")
        out = F.when(path.rlike("^" + rule) | bare.rlike("^" + rule), F.lit(p)).otherwise(out)
    return out


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("bigint")


def source_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def source_lines(text: Column) -> Column:
    return occurrences(text, "\n") + 1


def source_tokens(text: Column) -> Column:
    """Identifiers, numbers and single marks; Unicode white space separates."""
    return F.regexp_count(text, F.lit(SOURCE_TOKEN)).cast("bigint")


def slice_range(text: Column, start_line: Column, start_column: Column, end_line: Column, end_column: Column) -> Column:
    """The text of a range: lines count from 1, columns from 0 in code points, lines keep their line feed.

    Null where a bound is null or a line is out of range; columns past a line's end are cut to it.
    """
    raw = F.split(text, "\n", -1)
    n = F.size(raw) - F.when(F.element_at(raw, -1) == "", 1).otherwise(0)
    line = lambda k: F.concat(F.get(raw, (k - 1).cast("int")), F.when(k < F.size(raw), "\n").otherwise(""))
    from_start = F.substr(line(start_line), (start_column + 1).cast("int"))
    one = F.substr(line(start_line), (start_column + 1).cast("int"), F.greatest(end_column - start_column, F.lit(0)).cast("int"))
    between = F.slice(raw, (start_line + 1).cast("int"), F.greatest(end_line - start_line - 1, F.lit(0)).cast("int"))
    middle = F.array_join(F.transform(between, lambda x: F.concat(x, F.lit("\n"))), "")
    many = F.concat(from_start, middle, F.substr(line(end_line), F.lit(1), end_column.cast("int")))
    inside = (start_line >= 1) & (end_line >= start_line) & (end_line <= n) & start_column.isNotNull() & end_column.isNotNull()
    return F.when(inside, F.when(start_line == end_line, one).otherwise(many))


def stable_id(key: Column) -> Column:
    """The first 8 bytes of the SHA-256 of a key as an unsigned number."""
    return F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)")


def hash_fold(key: Column, folds: int) -> Column:
    """The first 4 bytes of the SHA-256 of a key, modulo *folds*."""
    return F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % folds


def percent_growth(newer: Column, older: Column) -> Column:
    return F.try_divide((newer - older) * F.lit(100.0), older)


def method_key(module: Column, owner: Column, name: Column, descriptor: Column) -> Column:
    return F.concat(module, F.lit("/"), owner, F.lit("#"), name, descriptor)


def log10_digits(digits: Column) -> Column:
    """log10 of a non-negative whole number written in decimal digits of any length; null for 0."""
    head = F.substr(digits, F.lit(1), F.lit(17))
    return F.when(digits != "0", F.log10(head.cast("double")) + (F.length(digits) - F.length(head)))


def digits_minus(digits: Column, less: Column) -> Column:
    """A number in decimal digits less a bigint: exact in ``decimal(38,0)`` up to 37 digits, beyond that by parts.

    Longer numbers are split after their first digits, and a borrow is carried; *less* must not exceed the number.
    """
    short = (F.substr(digits, F.lit(1), F.lit(37)).cast("decimal(38,0)") - less.cast("decimal(38,0)")).cast("string")
    low = F.right(digits, F.lit(36)).cast("decimal(38,0)") - less.cast("decimal(38,0)")
    high = F.substr(digits, F.lit(1), F.length(digits) - 36)
    base = F.lit("1" + "0" * 36).cast("decimal(38,0)")
    borrowed = F.concat(_decrement(high), F.lpad((low + base).cast("string"), 36, "0"))
    plain = F.concat(high, F.lpad(low.cast("string"), 36, "0"))
    long = F.regexp_replace(F.when(low < 0, borrowed).otherwise(plain), "^0+(?=.)", "")
    return F.when(F.length(digits) <= 37, short).otherwise(long)


def _decrement(digits: Column) -> Column:
    """A positive number in decimal digits less one."""
    zeros = F.regexp_extract(digits, "(0*)$", 1)
    head = F.substr(digits, F.lit(1), F.length(digits) - F.length(zeros))
    last = (F.right(head, F.lit(1)).cast("int") - 1).cast("string")
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), last, F.repeat(F.lit("9"), F.length(zeros)))


def comma_list(text: Column, kind: str = "string") -> Column:
    """The items of a comma-joined list as *kind*; an empty text is an empty list, a null one stays null."""
    none = F.array().cast(f"array<{kind}>")
    return F.when(text == "", none).otherwise(F.split(text, ",", -1).cast(f"array<{kind}>"))


def parent_class(label: Column) -> Column:
    """Kinds of parent labels: examples, private names, others."""
    return F.when(label.contains("_example"), "example").when(label.startswith("_private."), "private").otherwise("other")


# Contexts of usages outside all declarations, by the start of the trimmed line, tested in this order;
# a line that opens a bracket is a continuation if the nearest command above it is a variable command.
VARIABLE = ["variable ", "variables "]
BRACKETS = ["[", "{", "(", "⦃"]
HEADERS = ["set_option ", "@["]
SCOPES = ["open ", "namespace ", "section ", "end ", "export ", "notation", "infix", "prefix", "postfix", "macro", "syntax", "scoped", "include ", "omit ", "local ", "universe "]
COMMANDS = [
    "set_option ", "omit ", "include ", "section ", "namespace ", "open ", "attribute ", "alias ", "def ", "theorem ", "lemma ",
    "instance ", "example ", "structure ", "class ", "inductive ", "abbrev ", "opaque ", "@[", "local ",
]
LOOK_BACK = 15


def _starts(line: Column, prefixes: list[str]) -> Column:
    out = line.startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | line.startswith(p)
    return out


def continues_variable(lines: Column, at: Column) -> Column:
    """Whether the nearest command above line *at* (0-based, at most 15 lines up) is a variable command; blank lines and comments don't count."""
    low = F.greatest(at - LOOK_BACK, F.lit(0))
    above = F.reverse(F.slice(lines, (low + 1).cast("int"), (at - low).cast("int")))
    first = F.get(F.filter(above, lambda l: _starts(F.trim(l), VARIABLE + COMMANDS)), 0)
    return F.coalesce(_starts(F.trim(first), VARIABLE), F.lit(False))


def context_of(lines: Column, at: Column) -> Column:
    """The context of a usage outside all declarations, from its line (0-based)."""
    line = F.trim(F.get(lines, at.cast("int")))
    return (
        F.when(_starts(line, VARIABLE), "explicit_variable")
        .when(_starts(line, BRACKETS) & continues_variable(lines, at), "probable_variable_continuation")
        .when(_starts(line, HEADERS), "option_or_attribute_header")
        .when(line.startswith("attribute "), "attribute_command")
        .when(line.startswith("alias "), "alias_command")
        .when(_starts(line, SCOPES), "namespace_syntax_or_scope_command")
        .otherwise("other_command_or_continuation")
    )
