"""Lexical structure and control flow of code, file by file, and their sums by change."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line patterns of constructs by language; other extensions take GENERIC.
PYTHON = {
    "func_def": r"(?m)^\s*(def|async def)\s+(\w+)",
    "class_def": r"(?m)^\s*class\s+(\w+)",
    "if_nodes": r"(?m)^\s*(if|elif|else)\b",
    "loop_nodes": r"(?m)^\s*(for|while)\b",
    "try_nodes": r"(?m)^\s*(try|except|finally)\b",
    "return_nodes": r"(?m)^\s*(return|yield)\b",
    "assignment_nodes": r"(?m)^\s*\w[\w.]*\s*=\s*",
}
GO = {
    "func_def": r"(?m)^\s*func\s+(?:\([^)]*\)\s+)?(\w+)",
    "class_def": r"(?m)^\s*type\s+\w+\s+struct\b",
    "if_nodes": r"(?m)^\s*(if|else|switch|case|default)\b",
    "loop_nodes": r"(?m)^\s*for\b",
    "try_nodes": r"(?m)^\s*defer\b",
    "return_nodes": r"(?m)^\s*return\b",
    "assignment_nodes": r"(?m)^\s*\w[\w.]*\s*:?=\s*",
}
JAVASCRIPT = {
    "func_def": r"(?m)^\s*(function|async function|const\s+\w+\s*=\s*(async\s*)?\(|let\s+\w+\s*=\s*(async\s*)?\(|var\s+\w+\s*=\s*(async\s*)?\()",
    "class_def": r"(?m)^\s*class\s+\w+",
    "if_nodes": r"(?m)^\s*(if|else|switch|case|default)\b",
    "loop_nodes": r"(?m)^\s*(for|while|do)\b",
    "try_nodes": r"(?m)^\s*(try|catch|finally)\b",
    "return_nodes": r"(?m)^\s*return\b",
    "assignment_nodes": r"(?m)^\s*(const|let|var)\s+\w",
}
TYPESCRIPT = JAVASCRIPT | {
    "func_def": r"(?m)^\s*(function|async function|const\s+\w+\s*=\s*(async\s*)?\(|let\s+\w+\s*=\s*(async\s*)?\()",
    "class_def": r"(?m)^\s*(class|interface|type)\s+\w+",
}
GENERIC = {
    "func_def": r"(?m)^\s*(def|function|func|fn|async def|async function)\b|^\s*[\w<>[\]:,]+\s+\w+\s*\([^)]*\)\s*[\{:]",
    "class_def": r"(?m)^\s*(class|interface|struct|type)\s+\w+",
    "if_nodes": r"(?m)^\s*(if|else|elif|switch|case|default|match)\b",
    "loop_nodes": r"(?m)^\s*(for|while|do|range)\b",
    "try_nodes": r"(?m)^\s*(try|catch|except|finally|defer)\b",
    "return_nodes": r"(?m)^\s*(return|yield|raise|throw)\b",
    "assignment_nodes": r"(?m)^\s*(\w[\w.]*\s*=\s*|const\s+\w|let\s+\w|var\s+\w|\w+\s*:?=\s*)",
}
LEXICAL = {".py": PYTHON, ".go": GO, ".js": JAVASCRIPT, ".jsx": JAVASCRIPT, ".ts": TYPESCRIPT, ".tsx": TYPESCRIPT}
#: What a line of comment or documentation begins with.
COMMENT = r"^\s*(#|//|/\*|\*|'''|\"\"\")|^\s*$"

#: A line that begins with something else, and the white space before it where that is no comment at the line's start.
OWN_LINE = r"(?md)^[ \t\r\f]*+(?!#|//|/\*|\*|'''|\"\"\")\S"
INDENT = r"(?md)^(?!#|'''|\"\"\")([ \t]*)\S"

#: Java reads a bare bracket or two ampersands in a class as an operator.
GENERIC_JAVA = {k: p.replace("[\\w<>[\\]:,]", "[\\w<>\\[\\]:,]") for k, p in GENERIC.items()}


def _by_language(ext, of) -> Column:
    """of(patterns) for the language of the extension."""
    found = None
    for e, patterns in LEXICAL.items():
        found = F.when(ext == e, of(patterns)) if found is None else found.when(ext == e, of(patterns))
    return found.otherwise(of(GENERIC_JAVA))


def lexical_counts(code, ext) -> dict[str, Column]:
    """Counts of constructs by the extension's language."""
    return {k: _by_language(ext, lambda p, k=k: F.regexp_count(code, F.lit(p[k]))).cast("long") for k in PYTHON}


def indent_depth(code) -> Column:
    """Deepest indent in steps of four, plus one; comment and docstring lines don't count."""
    widths = F.transform(F.regexp_extract_all(code, F.lit(INDENT), F.lit(1)), F.length)
    return F.greatest(F.floor(F.coalesce(F.array_max(widths), F.lit(0)) / 4) + 1, F.lit(1)).cast("long")


def brace_depth(code) -> Column:
    """Deepest running balance of braces at line ends, plus one."""
    braces = F.split(F.regexp_replace(F.regexp_replace(code, r"[^{}\n]+", ""), r"\n+", "\n"), "\n")
    deltas = F.transform(braces, lambda x: F.length(F.replace(x, F.lit("}"))) - F.length(F.replace(x, F.lit("{"))))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda a, d: F.struct((a["now"] + d).alias("now"), F.greatest(a["most"], a["now"] + d).alias("most"))
    return F.greatest(F.aggregate(deltas, start, step)["most"] + 1, F.lit(1)).cast("long")


def depth(code, ext) -> Column:
    return F.when(ext == ".py", indent_depth(code)).otherwise(brace_depth(code))


CENSUS = [*PYTHON, "total_nodes"]


def census(files: DataFrame, code: str = "code", ext: str = "ext") -> DataFrame:
    """files with success, counts, total_nodes (the counts and the lines that are no comments) and max_depth; a blank text has none of them."""
    text = F.coalesce(F.col(code), F.lit(""))
    blank = ~text.rlike(r"\S")
    counts = lexical_counts(text, F.col(ext)) | {"max_depth": depth(text, F.col(ext)), "total_nodes": F.regexp_count(text, F.lit(OWN_LINE))}
    found = files.withColumns({"success": ~blank, **{k: F.when(blank, F.lit(0)).otherwise(c).cast("long") for k, c in counts.items()}})
    total = sum((F.col(k) for k in PYTHON), F.col("total_nodes"))  # from the columns, so that no pattern is searched for twice
    return found.withColumn("total_nodes", F.when(F.col("success"), F.greatest(total, F.lit(1))).otherwise(0).cast("long"))


def census_by(files: DataFrame, key: str) -> DataFrame:
    """Sums of census over the files of a change (depths too), the files tried and parsed, and the share parsed; depth_most is a true maximum."""
    sums = [F.sum(k).alias(k) for k in [*CENSUS, "max_depth"]]
    tried, parsed = F.count("*"), F.count_if("success")
    return files.groupBy(key).agg(*sums, F.max("max_depth").alias("depth_most"), tried.alias("files_attempted"), parsed.alias("files_parsed"), F.round(parsed / F.greatest(tried, F.lit(1)), 4).alias("parse_success_rate"))


# Line patterns of control flow by language, first match wins. No line of Python or of a language with braces gets to
# switch and case, as the pattern of "finally" stands before them there; Go has none.
FLOW_PYTHON = [
    ("exit", r"^(\s*)(return|raise|yield)\b"), ("jump", r"^(\s*)(break|continue)\b"), ("branch", r"^(\s*)(if|elif)\s+.*:\s*$"), ("else", r"^(\s*)(else)\s*:\s*$"),
    ("loop", r"^(\s*)(for|while)\s+.*:\s*$"), ("exception", r"^(\s*)(try)\s*:\s*$"), ("exception", r"^(\s*)(except)[\s:].*:\s*$"), ("exception", r"^(\s*)(finally)\s*:\s*$"),
]
FLOW_GO = [
    ("exit", r"^\s*(return|panic)\b"), ("jump", r"^\s*(break|continue|goto)\b"), ("branch", r"^\s*(if|else\s+if)\s+.*\{"), ("else", r"^\s*else\s*\{"), ("loop", r"^\s*for\s+.*\{"),
    ("exception", r"^\s*defer\b"), ("exception", r"^\s*if\s+err\s*!=\s*nil"), ("branch", r"^\s*switch\s+.*\{"), ("branch", r"^\s*(case|default)\s*:"),
]
FLOW_BRACES = [
    ("exit", r"^\s*(return|throw|raise|yield)\b"), ("jump", r"^\s*(break|continue)\b"), ("branch", r"^\s*(if|else\s+if|elif)\s*\(.*\)\s*\{?"), ("else", r"^\s*else\s*\{?"),
    ("loop", r"^\s*(for|while|do)\s*\(.*\)\s*\{?"), ("exception", r"^\s*try\s*\{?"), ("exception", r"^\s*(catch|except)\s*\(?.*\)?\s*\{?"), ("exception", r"^\s*finally\s*\{?"),
]
FLOWS = {".py": FLOW_PYTHON, ".go": FLOW_GO}


def flow_class(line, ext=None) -> Column:
    """The class of a line of code by its extension (Python without one)."""

    def ladder(rules):
        found = None
        for name, pattern in rules:
            found = F.when(line.rlike(pattern), name) if found is None else found.when(line.rlike(pattern), name)
        return found.otherwise("statement")

    if ext is None:
        return ladder(FLOW_PYTHON)
    return F.when(ext == ".py", ladder(FLOW_PYTHON)).when(ext == ".go", ladder(FLOW_GO)).otherwise(ladder(FLOW_BRACES))


FLOW_TYPE = "struct<nodes long, edges long, branches long, loops long, exits long, cyclomatic long, max_depth long, mean_out double>"
_READY = {e: [(n, re.compile(p)) for n, p in rules] for e, rules in (FLOWS | {"": FLOW_BRACES}).items()}
_COMMENT = re.compile(COMMENT)


#: The class and level of lines seen so far by extension, up to so many in all; code repeats its lines a lot.
_SEEN: dict[str, dict[str, tuple[str, int] | None]] = {}
LINES_KEPT = 200_000


def classified_line(line: str, ext: str) -> tuple[str, int] | None:
    """Class and level of a line, None for a comment. A block's head has the level at which it opens, by white space in Python and
    by its own braces elsewhere; all other lines have their white space."""
    if _COMMENT.match(line):
        return None
    name = next((n for n, r in _READY.get(ext, _READY[""]) if r.match(line)), "statement")
    head = name in ("branch", "else", "loop", "exception")
    return name, line.count("{") - line.count("}") if head and ext != ".py" else len(line) - len(line.lstrip())


def classified(lines: list[str], ext: str) -> list[tuple[str, int]]:
    """Class and level of each line that is no comment; a line that was seen before is looked up."""
    if sum(map(len, _SEEN.values())) > LINES_KEPT:
        _SEEN.clear()
    seen = _SEEN.setdefault(ext if ext in FLOWS else "", {})
    for line in set(lines).difference(seen):
        seen[line] = classified_line(line, ext)
    return [x for x in map(seen.__getitem__, lines) if x is not None]


def flow_features(code_lines: list[str], ext: str = ".py") -> tuple:
    """Nodes and edges of a simplified control-flow graph, folded over the classes and levels of the lines.

    Each line but an else makes a node, reached from the one before. A block's first plain line or exit is reached from the block's head
    as well, once for each head. An else takes the place of the branch that is open where it stands, which reaches it, and is nothing
    where no branch is open. What is open at a level not lower than a line's is closed before the line.
    """
    if not code_lines:
        return (0, 0, 0, 0, 0, 0, 0, 0.0)
    seen = {"branch": 0, "loop": 0, "exit": 0, "jump": 0}
    heads: list[tuple[int, int, bool]] = []  # node, level, whether it is a branch
    nodes, last, deepest, entering = 1, 0, 0, False
    sources, once, edges = set(), set(), 0
    for name, level in classified(code_lines, ext) or [("statement", 0)]:
        while heads and heads[-1][1] >= level:
            deepest = max(deepest, len(heads))
            heads.pop()
        if name == "else":
            if not (heads and heads[-1][2]):
                continue
            sources.add(heads[-1][0])
            heads[-1] = (nodes, level, True)
            seen["branch"] += 1
            entering = True
        else:
            sources.add(last)
            if name in seen:
                seen[name] += 1
            if name in ("branch", "loop"):
                heads.append((nodes, level, name == "branch"))
                entering = True
            elif name in ("statement", "exit"):
                if entering and heads:
                    if heads[-1][0] not in once:
                        once.add(heads[-1][0])
                        sources.add(heads[-1][0])
                        edges += 1
                    entering = False
            else:
                entering = False
        edges += 1
        last, nodes = nodes, nodes + 1
    return (nodes, edges, seen["branch"], seen["loop"], seen["exit"] + seen["jump"], max(0, edges - nodes + 2), deepest, round(edges / max(len(sources), 1), 4))


def _flows(code: pd.Series, ext: pd.Series) -> pd.DataFrame:
    names = [x.split(" ")[0] for x in FLOW_TYPE[7:-1].split(", ")]
    return pd.DataFrame([flow_features((c or "").split("\n") if c and c.strip() else [], e) for c, e in zip(code, ext, strict=True)], columns=names)


def flow(code, ext=None) -> Column:
    return F.pandas_udf(_flows, FLOW_TYPE)(code, F.lit(".py") if ext is None else ext)


def flow_by(files: DataFrame, key: str) -> DataFrame:
    """Sums of flow over the files of a change, the greatest depth, and edges by node."""
    sums = [F.sum(c).alias(c) for c in ("nodes", "edges", "branches", "loops", "exits", "cyclomatic")]
    some = F.count_if(F.col("nodes") > 0)
    return files.groupBy(key).agg(*sums, F.max("max_depth").alias("max_depth"), F.count("*").alias("files_processed"), some.alias("files_with_flow"), F.round(F.sum("edges") / F.greatest(F.sum("nodes"), F.lit(1)), 4).alias("mean_out"))


def samples(files: DataFrame, n: int, least: int = 50, ext: list[str] | None = None, code: str = "code") -> DataFrame:
    """The first n files of some languages with at least `least` characters of code, by key order."""
    rows = files.where(F.length(F.trim(code)) >= least)
    return (rows.where(F.col("ext").isin(ext)) if ext else rows).orderBy("file_id").limit(n)
