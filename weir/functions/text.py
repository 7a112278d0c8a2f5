"""Column functions over lines: fields, numbers, byte ranges, translation and search patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's names of the ASCII character classes.
_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s\x0B", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}"}


def fields(line: Column, delim: str = " \t") -> Column:
    """Non-empty fields; any character of delim splits, and runs of them count once."""
    return F.filter(F.split(line, "[" + re.escape(delim).replace("]", r"\]") + "]+"), lambda x: x != "")


def field(line: Column, n: int, delim: str = " \t") -> Column:
    """The n-th field from 1, from the end if negative; null where there is none."""
    return F.try_element_at(fields(line, delim), F.lit(n))


def number(s: Column) -> Column:
    """The number that a string begins with, as C's strtod reads it (decimal forms); null without one."""
    return F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def human_number(s: Column) -> Column:
    """A number with an abutting K, M, G, T, P or E suffix, powers of 1024."""
    suffix = F.upper(F.regexp_extract(s, r"^\s*[+-]?[\d.]+([kmgtpeKMGTPE])", 1))
    power = F.when(suffix == "", 0).otherwise(F.instr(F.lit("KMGTPE"), suffix))
    return number(s) * F.pow(F.lit(1024.0), power)


def cut(line: Column, lo: int = 1, hi: int | None = None) -> Column:
    """Bytes lo to hi from 1, as text."""
    raw = F.encode(line, "UTF-8")
    part = F.substring(raw, lo, hi - lo + 1) if hi is not None else F.substring(raw, lo, 1 << 30)
    return F.decode(part, "UTF-8")


def expand_set(s: str) -> str:
    """The characters of a translation set: ranges a-z and escapes."""
    s = s.replace(r"\n", "\n").replace(r"\t", "\t").replace(r"\\", "\\")
    out, i = "", 0
    while i < len(s):
        if i + 2 < len(s) and s[i + 1] == "-" and s[i] <= s[i + 2]:
            out += "".join(map(chr, range(ord(s[i]), ord(s[i + 2]) + 1)))
            i += 3
        else:
            out += s[i]
            i += 1
    return out


def tr(line: Column, set1: str, set2: str = "") -> Column:
    """Translate set1 to set2, a short set2 repeating its last character; an empty set2 deletes."""
    a, b = expand_set(set1), expand_set(set2)
    return F.translate(line, a, (b + b[-1:] * len(a))[: len(a)] if b else "")


def java_pattern(ere: str, icase: bool = False, word: bool = False, whole: bool = False) -> str:
    r"""An extended regular expression in Java's syntax: character classes, and \d as a plain d."""
    out, i, inside = "", 0, False
    while i < len(ere):
        c = ere[i]
        if inside and ere.startswith("[:", i) and (end := ere.find(":]", i)) > 0:
            if ere[i + 2 : end] not in _POSIX:
                raise ValueError(f"unknown class {ere[i + 2 : end]}")
            out += _POSIX[ere[i + 2 : end]]
            i = end + 2
            continue
        if inside:
            out += "\\" + c if c in "\\[&" else c
            inside = c != "]" or out.endswith(("[", "[^"))
        elif c == "[":
            inside = True
            out += c
            if ere.startswith("^", i + 1):
                out += "^"
                i += 1
            if ere.startswith("]", i + 1):
                out += r"\]"
                i += 1
        elif c == "\\" and i + 1 < len(ere):
            out += ere[i + 1] if ere[i + 1] == "d" else c + ere[i + 1]
            i += 1
        else:
            out += c
        i += 1
    if word:
        out = f"(?<![A-Za-z0-9_])(?:{out})(?![A-Za-z0-9_])"
    if whole:
        out = f"^(?:{out})$"
    return ("(?iu)" if icase else "") + out


def smart_case(patterns: list[str]) -> bool:
    """Whether a search folds case if left to itself: only where no pattern has a capital letter."""
    return all(p == p.lower() for p in patterns)


def matches(line: Column, patterns: list[str], literal: bool = False, icase: bool = False, word: bool = False, whole: bool = False, invert: bool = False) -> Column:
    """Whether a line holds any pattern; an empty pattern matches every line, no pattern none."""
    if literal and not (icase or word or whole):
        hit = [F.contains(line, F.lit(p)) for p in patterns]
    else:
        hit = [line.rlike(java_pattern(re.escape(p) if literal else p, icase, word, whole)) for p in patterns]
    any_ = F.lit(False)
    for h in hit:
        any_ = any_ | h
    return ~any_ if invert else any_


def replace(line: Column, pattern: str, by: str) -> Column:
    r"""Every match by a text with references \0 to \9."""
    by = re.sub(r"\\(\d)", r"${\1}", by.replace("$", r"\$")).replace("${", "$").replace("}", "")
    return F.regexp_replace(line, java_pattern(pattern), by)


def hamming_contains(line: Column, needle: str, k: int) -> Column:
    """Whether a window of the needle's length differs from it in at most k characters.

    One of k + 1 pieces of the needle must occur unchanged, which rules out most lines cheaply.
    """
    m = len(needle)
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    pieces = [needle[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
    some = F.lit(False)
    for p in pieces:
        some = some | F.contains(line, F.lit(p))
    if not m:
        return F.lit(True)
    return some & (F.length(line) >= m) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(line) - m + 1, F.lit(1))), lambda i: sum((F.when(line.substr(i + j, F.lit(1)) != c, 1).otherwise(0) for j, c in enumerate(needle)), F.lit(0)) <= k)


def padded(line: Column, widths: list[int], delim: str = " \t", gap: str = "  ") -> Column:
    """Fields in columns of these widths, the last one of a line not padded; fields beyond the widths follow as they are."""
    f = fields(line, delim)
    w = F.array(*(F.lit(x) for x in widths)) if widths else F.array().cast("array<int>")
    cell = lambda x, i: F.when(i < F.size(f) - 1, F.rpad(x, F.greatest(F.coalesce(F.get(w, i), F.lit(0)), F.length(x)), F.lit(" "))).otherwise(x)
    return F.array_join(F.transform(f, cell), gap)


def human_count(n: Column, units: tuple[str, ...] = ("", "k", "M", "G", "T")) -> Column:
    """A count with one decimal and a unit: 1700000 is 1.7M; whole below a thousand and from 99.95 units on; the last unit has no upper end."""
    unit, v = F.lit(units[-1]), n / 1e3 ** (len(units) - 1)
    for i in reversed(range(len(units) - 1)):
        small = F.abs(n) < 1e3 ** (i + 1)
        unit, v = F.when(small, units[i]).otherwise(unit), F.when(small, n / 1e3**i).otherwise(v)
    return F.when((unit == "") | (F.abs(v) >= 99.95), F.concat(F.bround(v, 0).cast("long").cast("string"), unit)).otherwise(F.concat(F.format_number(F.bround(v, 1), 1), unit))


def process_filter(name: Column, user: Column, cpu: Column, text: str = "", pattern: str = "", owner: str = "", least: float | None = None) -> Column:
    """Rows whose name holds text in any case and matches pattern, of that owner, with that much CPU; a part that is empty, or a pattern that is none, filters nothing."""
    keep = F.lit(True)
    if text:
        keep = keep & F.contains(F.lower(name), F.lit(text.lower()))
    if pattern:
        try:
            re.compile(pattern)
            keep = keep & name.rlike(java_pattern(pattern))
        except re.error:
            pass
    if owner:
        keep = keep & (user == owner)
    return keep & (cpu >= least) if least is not None else keep
