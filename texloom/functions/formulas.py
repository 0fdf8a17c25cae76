"""Column functions on LaTeX: cleaning, kind, symbols, complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names in the order in which alternatives are tried (fixed values).
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
FUNCTIONS = "sin cos tan sinh cosh tanh log ln exp sqrt det sum prod int lim max min arg sup inf".split()
OPERATORS = "cdot times div pm mp leq geq neq approx equiv subset supset subseteq supseteq in notin cap cup".split()
CONSTANTS = "pi infty partial".split()


def cleaned(latex: Column) -> Column:
    """Without delimiters, blanks joined."""
    out = F.btrim(latex)
    for pattern in (r"(?s)^\$\$(.*)\$\$$", r"(?s)^\$(.*)\$$", r"(?s)^\\\[(.*)\\\]$", r"(?s)^\\\((.*)\\\)$"):
        out = F.regexp_replace(out, pattern, "$1")
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def kind(latex: Column) -> Column:
    """equation or inline."""
    has = lambda x: F.contains(latex, F.lit(x))
    wide = (F.length(latex) > 50) | has("\\frac") | has("\\sum")
    return F.when(has("\\[") | has("$$") | has("equation}"), "equation").when(has("\\(") | has("$"), "inline").when(wide, "equation").otherwise("inline")


def _named(latex: Column, names: list[str], strict: bool) -> Column:
    return F.regexp_extract_all(latex, F.lit(r"\\(" + "|".join(names) + ")" + (r"(?![A-Za-z])" if strict else "")), F.lit(1))


def functions(latex: Column, strict: bool = False) -> Column:
    called = F.regexp_extract_all(latex, F.lit(r"([a-zA-Z]+)\s*\("), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(_named(latex, FUNCTIONS, strict), called)))


def operators(latex: Column, strict: bool = False) -> Column:
    """``strict`` asks that a name ends where it is matched; by default the first alternative that fits counts."""
    signs = F.regexp_extract_all(latex, F.lit(r"([+\-*/=<>])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(_named(latex, OPERATORS, strict), signs)))


def constants(latex: Column, strict: bool = False) -> Column:
    numbers = F.regexp_extract_all(latex, F.lit(r"\b([0-9]+(?:\.[0-9]+)?)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(_named(latex, CONSTANTS, strict), numbers)))


def variables(latex: Column) -> Column:
    letters = F.regexp_extract_all(latex, F.lit(r"\b([a-zA-Z])\b"), F.lit(1))
    greek = F.regexp_extract_all(latex, F.lit(r"\\(" + "|".join(GREEK) + ")"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(F.concat(letters, greek)), F.array(*map(F.lit, FUNCTIONS))))


def complexity(latex: Column, n_variables: Column, n_functions: Column, n_operators: Column) -> Column:
    """From length, symbols and constructs, at most 10."""
    extra = F.when(F.contains(latex, F.lit("\\frac")), 2.0).otherwise(0.0)
    extra += F.when(F.contains(latex, F.lit("\\sum")) | F.contains(latex, F.lit("\\int")), 3.0).otherwise(0.0)
    extra += F.when(F.contains(latex, F.lit("\\sqrt")), 1.0).otherwise(0.0)
    extra += F.when(F.contains(latex, F.lit("\\matrix")) | F.contains(latex, F.lit("\\begin{")), 4.0).otherwise(0.0)
    return F.least(F.lit(10.0), 0.01 * F.length(latex) + 0.5 * n_variables + n_functions + 0.3 * n_operators + extra)
