"""Macro text: variables produced and consumed, calls and their arguments, bodies with parameters, cross-chunk resolution."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.text import canonical, expanded, named_datasets, normalised, statements


def produced(text: Column) -> Column:
    """Names that %LET, %GLOBAL, %LOCAL, CALL SYMPUT with a literal, and INTO assign, sorted."""
    low = F.lower(text)
    let = F.regexp_extract_all(low, F.lit(r"%\s*let\s+([a-z_]\w*)\s*="), F.lit(1))
    scope = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"%\s*(?:global|local)\s+([a-z_][\w\s]*)"), F.lit(1)), lambda s: F.split(F.trim(s), r"\s+")))
    symput = F.regexp_extract_all(low, F.lit(r"\bcall\s+symputx?\s*\(\s*['\"]([a-z_]\w*)['\"]"), F.lit(1))
    targets = F.array_join(F.regexp_extract_all(low, F.lit(r"\binto\s+((?::\s*[a-z_]\w*[\s,\-]*)+)"), F.lit(1)), ", ")
    into = expanded(F.regexp_extract_all(targets, F.lit(r":\s*([a-z_]\w*(?:\s*-\s*:\s*[a-z_]\w*)?)"), F.lit(1)))
    return F.sort_array(F.array_distinct(F.filter(F.concat(let, scope, symput, into), lambda x: x != "")))


def consumed(text: Column, parameters: Column | None = None) -> Column:
    """&names in order of name, without automatic ones (sys...) and without the macro's own parameters."""
    names = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"&+([a-z_]\w*)"), F.lit(1)))
    own = F.filter(names, lambda x: ~x.startswith("sys"))
    return F.sort_array(F.array_except(own, parameters) if parameters is not None else own)


def signature(text: Column) -> Column:
    """Parameter names of a macro definition, in order."""
    inside = F.regexp_extract(normalised(text), r"^%\s*macro\s+\w+\s*\(([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda p: F.trim(F.substring_index(p, "=", 1))), lambda p: p != "")


def macro_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(normalised(text), r"^%\s*macro\s+([a-z_]\w*)", 1), F.lit(""))


def symput_hazard(text: Column, parameters: Column) -> Column:
    """Whether a computed scope may keep a published value local: CALL SYMPUT in a macro with parameters or %LOCAL, without an explicit 'G'."""
    low = F.lower(text)
    publishes = low.rlike(r"\bcall\s+symputx?\s*\(") & ~low.rlike(r"\bcall\s+symputx\s*\([^;]*,\s*['\"]g['\"]\s*\)")
    return (publishes & ((F.size(parameters) > 0) | low.rlike(r"%\s*local\b"))).cast("int")


def executed(text: Column) -> Column:
    """The literal first piece of CALL EXECUTE."""
    return F.nullif(F.regexp_extract(F.lower(text), r"\bcall\s+execute\s*\(\s*['\"]%?([a-z_]\w*)", 1), F.lit(""))


#: A quoted string, a bracket, a comma, or anything else.
_TOKEN = re.compile(r"'[^']*(?:''[^']*)*'?|\"[^\"]*(?:\"\"[^\"]*)*\"?|[()\[\]{},]|[^'\"()\[\]{},]+")
_DEEPER = dict.fromkeys("([{", 1) | dict.fromkeys(")]}", -1)


def arguments(text: str) -> tuple[list[str], int]:
    """Parts between the commas outside of brackets and strings, up to the bracket that closes what was open before text; and where that stands."""
    tokens = list(_TOKEN.finditer(text))
    depth = list(itertools.accumulate(_DEEPER.get(t[0], 0) for t in tokens))
    end = next((t.start() for t, d in zip(tokens, depth, strict=True) if d < 0), len(text))
    cuts = [t.start() for t, d in zip(tokens, depth, strict=True) if t[0] == "," and d == 0 and t.start() < end]
    parts = [text[a:b].strip() for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, end], strict=True)]
    return (parts if len(parts) > 1 or parts[0] else []), end


def _call(text: str) -> tuple[str, list[str]] | None:
    m = re.match(r"\s*%([a-z_]\w*)\s*(\()?", text, re.I)
    return (m[1].lower(), arguments(text[m.end() :])[0] if m[2] else []) if m else None


def calls(chunks: DataFrame, key: str = "idx", text: str = "text") -> DataFrame:
    """key, macro, pos (1-based; 0 for a call without arguments), param (of a keyword argument), value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                if found := _call(t or ""):
                    for i, a in enumerate(found[1], 1):
                        m = re.match(r"([A-Za-z_]\w*)\s*=(.*)", a, re.S)
                        rows.append((k, found[0], i, m[1].lower() if m else None, (m[2] if m else a).strip()))
                    if not found[1]:
                        rows.append((k, found[0], 0, None, None))
            yield pd.DataFrame(rows, columns=[key, "macro", "pos", "param", "value"])

    return chunks.select(key, text).mapInPandas(run, f"{key} {chunks.schema[key].dataType.simpleString()}, macro string, pos int, param string, value string")


def invocations(call_rows: DataFrame, definitions: DataFrame, key: str = "idx") -> DataFrame:
    """Edges (from_idx, to_idx, macro) from the last definition of each called macro, even one that follows the call. definitions: idx, macro."""
    last = definitions.groupBy("macro").agg(F.max("idx").alias("from_idx"))
    return call_rows.select(F.col(key).alias("to_idx"), "macro").distinct().join(last, "macro").select("from_idx", "to_idx", "macro")


def resolve_bodies(call_rows: DataFrame, bodies: DataFrame, key: str = "idx") -> DataFrame:
    """idx, direction, name: what a call reads and writes once its arguments stand in the macro's body.

    bodies: macro, direction (in, out), pos of the parameter that names the dataset (0: a literal), name (the literal), param. All calls are
    resolved first; their rows join the producers at the call's index, so one window links them afterwards.
    """
    args = call_rows.where("pos > 0").select(key, "macro", F.col("pos").alias("_pos"), F.col("param").alias("_param"), "value")
    every = call_rows.select(key, "macro").distinct().join(bodies, "macro")
    by_pos = every.join(args, [key, "macro"], "left").where("pos = 0 or (_param is null and _pos = pos) or _param = param")
    name = F.when(F.col("pos") == 0, F.col("name")).otherwise(F.col("value"))
    return by_pos.select(key, "direction", canonical(name).alias("name")).where("name is not null").distinct()


def definitions(chunks: DataFrame) -> DataFrame:
    """source_id, macro, parameters (with defaults), refs (datasets of the body whose names have a & in them), inner (the calls in the body).

    chunks: source_id, idx, text of macro definitions. The last definition of a name counts.
    """
    inside = F.regexp_extract(normalised(F.col("text")), r"^%\s*macro\s+\w+\s*\(([^)]*)\)", 1)
    pair = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("param"), F.when(F.contains(p, F.lit("=")), F.trim(F.regexp_replace(p, r"^[^=]*=", ""))).otherwise("").alias("value"), F.contains(p, F.lit("=")).alias("by_name"))
    parameters = F.filter(F.transform(F.split(inside, ","), pair), lambda p: p["param"] != "")
    reads, writes = named_datasets(F.col("text"))
    open_ = lambda names, way: F.transform(F.filter(names, lambda x: F.contains(x, F.lit("&"))), lambda x: F.struct(F.lit(way).alias("direction"), x.alias("name")))
    inner = F.filter(statements(F.col("text")), lambda x: x.rlike(rf"^% ?(?!(?:{_CONTROL})\b)[a-z_]"))
    found = chunks.select("source_id", "idx", macro_name(F.col("text")).alias("macro"), parameters.alias("parameters"), F.array_distinct(F.concat(open_(reads, "in"), open_(writes, "out"))).alias("refs"), F.array_distinct(inner).alias("inner")).where("macro is not null")
    last = F.max_by(F.struct("parameters", "refs", "inner"), "idx").alias("d")
    return found.groupBy("source_id", "macro").agg(last).select("source_id", "macro", "d.*")


#: Words after a percent sign that aren't the name of a macro.
_CONTROL = "macro|mend|let|put|global|local|if|then|else|do|end|return|goto|abort|include|str|nrstr|quote|eval|sysevalf|sysfunc"


def _with_arguments(calls_: DataFrame, key: str) -> DataFrame:
    """key, macro, args (in their order) of call texts."""
    one = calls(calls_, key).groupBy(key, "macro").agg(F.array_sort(F.collect_list(F.struct("pos", "param", "value"))).alias("a"))
    real = F.filter("a", lambda x: x["pos"] > 0)
    return one.select(key, "macro", F.transform(real, lambda x: F.struct(x["param"].alias("param"), x["value"].alias("value"))).alias("args"))


def _bound(parameters: Column, args: Column) -> Column:
    """Each parameter with what a call gives it: by name, by its place (those without a default), or its default."""

    def value(p: Column, k: Column) -> Column:
        named = F.filter(args, lambda a: a["param"] == p["param"])
        placed = F.filter(args, lambda a: a["param"].isNull())
        given = F.when(F.size(named) > 0, F.get(named, F.lit(0))["value"]).when(~p["by_name"], F.get(placed, k)["value"])
        return F.struct(p["param"].alias("param"), F.coalesce(F.nullif(given, F.lit("")), p["value"]).alias("value"))

    return F.transform(parameters, value)


def _settled(bound: Column) -> Column:
    """bound, with what defaults say by other parameters replaced."""
    return F.transform(bound, lambda b: F.struct(b["param"].alias("param"), _substituted(b["value"], bound).alias("value")))


def _substituted(text: Column, bound: Column) -> Column:
    """text with &name and &name. replaced."""
    swap = lambda t, b: F.regexp_replace(t, F.concat(F.lit("&+"), b["param"], F.lit(r"(?!\w)\.?")), F.regexp_replace(b["value"], r"([$\\])", r"\\$1"))
    return F.aggregate(bound, text, swap)


def body_datasets(chunks: DataFrame, calls_: DataFrame, rounds: int = 50) -> DataFrame:
    """source_id, idx, direction (in, out), name: datasets that macro calls read and write by the names which their arguments give.

    chunks: source_id, idx, text of macro definitions; calls_: source_id, idx, text of calls. The closure over the call graph: calls are joined
    to bodies, parameters are replaced in the bodies' names and in the arguments of the calls inside, and what these call comes next,
    until no call is new. A macro that is called while it is being expanded is refused: that call is left out. Names that still hold a & are
    nobody's.
    """
    from quarry.operators.graph import _cut

    bodies = _cut(definitions(chunks))
    nested = bodies.select("source_id", "macro", F.posexplode("inner").alias("n", "text")).withColumn("key", F.struct("source_id", "macro", "n"))
    inner = _cut(_with_arguments(nested, "key").select("key.source_id", F.col("key.macro").alias("outer"), F.col("macro").alias("called"), "args"))
    first = _with_arguments(calls_.withColumn("key", F.struct("source_id", "idx")), "key")
    now = _cut(first.select("key.source_id", "key.idx", "macro", "args", F.array("macro").alias("path")))
    met, found = None, []
    for _ in range(rounds):
        bound = now.join(bodies, ["source_id", "macro"]).select("source_id", "idx", "macro", "path", "refs", _bound(F.col("parameters"), F.col("args")).alias("bound"))
        bound = _cut(bound.withColumn("bound", _settled(F.col("bound"))))
        names = bound.select("source_id", "idx", "bound", F.explode("refs").alias("r")).select("source_id", "idx", "r.direction", _substituted(F.col("r.name"), F.col("bound")).alias("name"))
        found.append(_cut(names.where("not contains(name, '&') and name <> ''").select("source_id", "idx", "direction", canonical(F.col("name")).alias("name")).distinct()))
        swapped = F.transform("args", lambda a: F.struct(a["param"].alias("param"), _substituted(a["value"], F.col("bound")).alias("value")))
        deeper = bound.join(inner.withColumnRenamed("outer", "macro"), ["source_id", "macro"]).where("not array_contains(path, called)")
        deeper = deeper.select("source_id", "idx", F.col("called").alias("macro"), swapped.alias("args"), F.concat("path", F.array("called")).alias("path"))
        states = ["source_id", "idx", "macro", "args"]
        new = deeper.groupBy(*states).agg(F.min("path").alias("path"))
        met = now.select(*states) if met is None else met.union(now.select(*states))
        now = _cut(new.join(met, states, "left_anti"))
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"calls are nested more than {rounds} deep")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct()


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_rn = 1").drop("_rn")
