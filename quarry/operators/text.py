"""Program and document text: statements, chunks, constructs, sections, windows, headers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# ---- statements


def scan_statements(text: str) -> list[tuple[int, int, str, bool, bool, bool]]:
    """(start, end, text, is_comment, terminated, unclosed_comment): quotes (doubled ones inside), /* */ and ; end at ;, with the white space after it."""
    out, at, n = [], 0, len(text)
    stop, blank = re.compile(r"['\"]|/\*|;"), re.compile(r"\s*")
    begins = lambda mark: text.startswith(mark, blank.match(text, at).end())

    def close(end: int, comment: bool, terminated: bool, unclosed: bool = False) -> int:
        while end < n and text[end].isspace():
            end += 1
        out.append((at, end, text[at:end], comment, terminated, unclosed))
        return end

    while at < n:
        i, done = at, False
        if begins("/*"):
            k = text.find("*/", text.index("/*", at) + 2)
            at = close(n if k < 0 else k + 2, True, k >= 0, k < 0)
            continue
        while not done:
            m = stop.search(text, i)
            if not m:
                at = close(n, begins("*"), False)
                break
            if m[0] == ";":
                at, done = close(m.end(), begins("*"), True), True
            elif m[0] == "/*":
                k = text.find("*/", m.end())
                if k < 0:
                    at = close(n, False, False, True)
                    break
                i = k + 2
            else:
                k = m.end()
                while True:
                    k = text.find(m[0], k)
                    if k < 0 or text[k : k + 2] != m[0] * 2:
                        break
                    k += 2
                i = n if k < 0 else k + 1
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores by keys. A table of few bytes is read by few tasks, however much work a row is; a given number is kept as it is."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def units(programs: DataFrame, source: str = "source_id", text: str = "text") -> DataFrame:
    """source_id, unit_no, start_char, end_char, text, is_comment, terminated, unclosed_comment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, i, *u) for s, t in zip(pdf[source], pdf[text], strict=True) for i, u in enumerate(scan_statements(t or ""), 1)]
            yield pd.DataFrame(rows, columns=["source_id", "unit_no", "start_char", "end_char", "text", "is_comment", "terminated", "unclosed_comment"])

    return spread(programs.select(source, text), source, text).mapInPandas(run, "source_id string, unit_no int, start_char int, end_char int, text string, is_comment boolean, terminated boolean, unclosed_comment boolean")


def normalised(text: Column) -> Column:
    """One space for white space, no final semicolon, lower case."""
    one = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s*;$", "")
    return F.lower(one)


#: What a statement is, by its first word; after a percent sign, by the word that follows it (any other word there is a macro call).
WORDS = {
    "data": "DATA_STEP", "proc": "PROC_STEP", "run": "STEP_BOUNDARY", "quit": "STEP_BOUNDARY", "options": "OPTIONS", "libname": "GLOBAL_STATEMENT", "filename": "GLOBAL_STATEMENT",
    "title": "GLOBAL_STATEMENT", "footnote": "GLOBAL_STATEMENT", "ods": "GLOBAL_STATEMENT", "format": "FORMAT_OR_INFORMAT", "informat": "FORMAT_OR_INFORMAT",
}
MACRO_WORDS = {"macro": "MACRO_DEFINITION", "include": "INCLUDE"} | dict.fromkeys(("let", "put", "global", "local"), "GLOBAL_STATEMENT") | dict.fromkeys(("if", "else", "do", "end", "return", "goto", "abort"), "MACRO_CONTROL_FLOW")


def _looked_up(word: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), word)


def kind(text: Column) -> Column:
    head = F.regexp_extract(normalised(text), r"^%?\s*[a-z_]\w*", 0)
    word = F.regexp_extract(head, r"\w+", 0)
    plain = F.coalesce(_looked_up(word, WORDS), F.when(word.rlike(r"^(title|footnote)\d+$"), "GLOBAL_STATEMENT"))
    return F.when(head == "", None).when(head.startswith("%"), F.coalesce(_looked_up(word, MACRO_WORDS), F.lit("MACRO_CALL"))).otherwise(plain)


#: The columns of a chunk after its source.
CHUNK = ["chunk_no", "kind", "first_unit", "last_unit", "start_char", "end_char", "text"]


class Grouping:
    """The units of one source, in order, grouped into steps: an opener starts a chunk, RUN, QUIT or %MEND ends it, a new opener ends it too.

    Steps inside a macro belong to it. add() and flush() return the chunks (in the order of CHUNK) that are ended.
    """

    OPENERS, ENDERS = {"DATA_STEP", "PROC_STEP", "MACRO_DEFINITION"}, re.compile(r"^(run|quit)\b")

    def __init__(self):
        self.no, self.held, self.what, self.depth = 0, [], None, 0

    def flush(self) -> list[tuple]:
        if not self.held:
            return []
        self.no += 1
        first, last = self.held[0], self.held[-1]
        row = (self.no, self.what or "UNKNOWN_STATEMENT_GROUP", int(first.unit_no), int(last.unit_no), int(first.start_char), int(last.end_char), "".join(u.text for u in self.held))
        self.held, self.what, self.depth = [], None, 0
        return [row]

    def add(self, u) -> list[tuple]:
        k, n = u.kind, u.normal
        if self.what == "MACRO_DEFINITION":
            self.held.append(u)
            self.depth += (k == "MACRO_DEFINITION") - bool(re.match(r"%\s*mend\b", n))
            return self.flush() if self.depth == 0 else []
        if k in self.OPENERS:
            done = self.flush()
            self.held, self.what, self.depth = [u], k, 1
            return done
        if self.what in self.OPENERS:
            self.held.append(u)
            return self.flush() if self.ENDERS.match(n) else []
        if k is None and not u.is_comment:
            done = self.flush() if self.what is not None else []
            self.held.append(u)
            return done
        done = self.flush()
        self.held, self.what = [u], "COMMENT_BLOCK" if u.is_comment else k
        return done + self.flush()


def described_units(found: DataFrame) -> DataFrame:
    """Units with their kind and normal form, as Grouping reads them."""
    return found.withColumn("kind", F.when(~F.col("is_comment"), kind(F.col("text")))).withColumn("normal", normalised(F.col("text")))


def chunks(found: DataFrame) -> DataFrame:
    """Units grouped into steps (see Grouping): source_id, chunk_no, kind, first_unit, last_unit, start_char, end_char, text."""
    columns = ["source_id", *CHUNK]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, group = None, Grouping()
        for pdf in batches:
            rows = []
            for u in pdf.itertuples(index=False):
                if u.source_id != source:
                    rows += [(source, *x) for x in group.flush()]
                    source, group = u.source_id, Grouping()
                rows += [(source, *x) for x in group.add(u)]
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame([(source, *x) for x in group.flush()], columns=columns)

    schema = "source_id string, chunk_no int, kind string, first_unit int, last_unit int, start_char int, end_char int, text string"
    return described_units(found).repartition("source_id").sortWithinPartitions("source_id", "unit_no").mapInPandas(run, schema)


def sanitised(text: str) -> str:
    """Comments and the insides of strings blanked; the length and line ends stay."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    out, at = [], 0
    for m in re.finditer(r"/\*.*?(?:\*/|\Z)|'(?:[^']|'')*'?|\"(?:[^\"]|\"\")*\"?", text, re.S):
        whole = m[0]
        out += [text[at : m.start()], blank(whole) if whole.startswith("/*") else whole[0] + blank(whole[1:-1]) + (whole[-1] if len(whole) > 1 else "")]
        at = m.end()
    return "".join([*out, text[at:]])


def blanked(text: Column) -> Column:
    """text in lower case with comments as a space and strings as an empty pair of quotes; a quote in a comment and a comment in a string count for nothing."""
    pattern = r"/\*[\s\S]*?(?:\*/|\z)|(')[^']*(?:''[^']*)*(?:'|\z)|(\")[^\"]*(?:\"\"[^\"]*)*(?:\"|\z)"
    return F.regexp_replace(F.lower(text), pattern, " $1$1$2$2")


def statements(text: Column) -> Column:
    """The statements of a text, blanked, without comments of either sort and without the lines of data that follow DATALINES."""
    code = F.regexp_replace(blanked(text), r"\b((?:datalines|cards)4?)\s*;[^;]*;", "$1;")
    return F.filter(F.transform(F.split(code, ";"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: (s != "") & ~s.rlike(r"^%?\*"))


#: Constructs that a clause is by its first word, where another word, a string or an array's name follows.
LEADING = {"array": "array", "modify": "modify", "update": "update", "infile": "infile", "file": "file_output", "link": "link", "goto": "goto"}


#: Access methods of FILENAME; each is a construct, emailsys as email. Fixed values.
ACCESS = ("email", "emailsys", "ftp", "pipe", "sftp", "socket", "url")


def constructs(text: Column) -> Column:
    """The names of constructs in a text, sorted: found in the words of its clauses, so that neither comments nor strings count."""
    clauses = F.flatten(F.transform(statements(text), lambda s: F.split(s, r"\b(?:then|else)\b")))
    words_ = F.transform(clauses, lambda c: F.regexp_extract_all(c, F.lit(r"%?[a-z_&][\w.&]*|''|\"\"|[=(]"), F.lit(0)))
    at = lambda w, k: F.coalesce(F.get(w, F.lit(k)), F.lit(""))
    name = lambda x: x.rlike(r"^[a-z_&]")
    by = F.exists(words_, lambda w: (at(w, 0) == "by") & name(at(w, 1)))

    def of(w: Column) -> Column:
        first, second, third = (at(w, k) for k in range(3))
        quoted = second.isin("''", '""')
        led = F.when(name(second) | (quoted & first.isin("infile", "file")), _looked_up(first, LEADING))
        do = F.when(first == "do", F.when((second == "while") & (third == "("), "do_while").when((second == "until") & (third == "("), "do_until").when(name(second) & (third == "="), "do_loop"))
        joined = F.when((first == "merge") & name(second), F.when(by, "merge").otherwise("merge_no_by"))
        reached = F.when((first == "filename") & name(second) & third.isin(*ACCESS), F.concat(F.lit("filename_"), F.regexp_replace(third, "sys$", "")))
        edge = F.when(F.exists(w, lambda x: x.rlike(r"^(first|last)\.[a-z_]")), "first_last")
        return F.array(F.coalesce(led, do, joined, reached, F.when(first == "retain", "retain"), F.when((first == "go") & (second == "to") & name(third), "goto")), edge)

    found = F.flatten(F.transform(words_, of))
    return F.sort_array(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


_NAME = r"[a-z_&][\w.&]*"
_ITEM = rf"{_NAME}(?:\s+(?:as\s+)?[a-z_]\w*)?"


def _all(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(1))


def expanded(names: Column) -> Column:
    """m1-m3 becomes m1, m2, m3."""
    spread = r"^(.*?)(\d+)\s*-\s*:?\s*\1(\d+)$"
    part = lambda x, k: F.regexp_extract(x, spread, k)
    run = lambda x: F.transform(F.sequence(part(x, 2).try_cast("int"), part(x, 3).try_cast("int")), lambda k: F.concat(part(x, 1), k.cast("string")))
    return F.flatten(F.transform(names, lambda x: F.when(x.rlike(spread) & (part(x, 2).try_cast("int") <= part(x, 3).try_cast("int")), run(x)).otherwise(F.array(x))))


def _listed(s: Column) -> Column:
    """The names after the first word of a statement, options in brackets and name=value aside; ranges are spelt out."""
    bare = s
    for _ in range(3):  # brackets within brackets
        bare = F.regexp_replace(bare, r"\([^()]*\)", " ")
    names = _all(F.regexp_replace(F.regexp_replace(bare, r"\b[a-z_]\w*\s*=\s*\S+", " "), r"/.*$", ""), rf"(?:^|\s)({_NAME}(?:\s*-\s*{_NAME})?)")
    return expanded(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))))


#: Stands for a subquery in the query around it.
_INNER = "\x01"


def _queries(s: Column) -> Column:
    """A statement's queries, each with its subqueries taken out (up to four deep)."""
    out, rest = [], s
    for _ in range(4):
        out.append(_all(rest, r"\(([^()]*)\)"))
        rest = F.regexp_replace(rest, r"\([^()]*\)", f" {_INNER} ")
    return F.concat(*out, F.array(rest))


def _sources(s: Column) -> Column:
    """The tables after FROM (lists, too) and JOIN of a statement and its subqueries."""
    item = rf"(?:{_INNER}|{_NAME})(?:\s+(?:as\s+)?(?!(?:where|join|left|right|full|inner|cross|natural|on|group|order|having|union|except|intersect|outer)\b)[a-z_]\w*)?"
    lists = F.flatten(F.transform(_queries(s), lambda q: _all(q, rf"\bfrom\s+({item}(?:\s*,\s*{item})*)")))
    froms = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, r"\s*,\s*"), lambda y: F.regexp_extract(y, rf"^({_NAME})", 1))))
    return F.filter(F.concat(F.filter(froms, lambda x: x != ""), _all(s, rf"\bjoin\s+({_NAME})")), lambda x: x != "connection")


def _in_place(s: Column) -> Column:
    """The table that an UPDATE or DELETE of SQL changes; empty for other statements (UPDATE of a DATA step has no SET with an equal sign)."""
    return F.concat(_all(s, rf"^update\s+({_NAME})\s+(?:as\s+)?(?:[a-z_]\w*\s+)?set\s+[a-z_][\w.]*\s*="), _all(s, rf"^delete\s+from\s+({_NAME})"))


def _reads(s: Column) -> Column:
    first, none = F.regexp_extract(s, r"^[a-z_]\w*", 0), F.array().cast("array<string>")
    changed = _in_place(s)
    return F.concat(
        changed,
        F.when(first.isin("set", "merge", "modify") | ((first == "update") & (F.size(changed) == 0)), _listed(s)).otherwise(none),
        F.when(first == "proc", _all(s, rf"\b(?:data|compare)\s*=\s*({_NAME})")).otherwise(none),
        F.when(first.isin("create", "select", "insert", "delete") | ((first == "update") & (F.size(changed) > 0)), _sources(s)).otherwise(none),
    )


def _writes(s: Column) -> Column:
    first, none = F.regexp_extract(s, r"^[a-z_]\w*", 0), F.array().cast("array<string>")
    out = _all(s, rf"\b(?:out|base)\s*=\s*({_NAME})")
    sorts = s.rlike(r"^proc sort\b") & (F.size(out) == 0)
    return F.concat(
        _in_place(s),
        F.when(first == "data", F.filter(_listed(s), lambda x: x != "_null_")).otherwise(none),
        F.when(first == "proc", F.when(sorts, _all(s, rf"\bdata\s*=\s*({_NAME})")).otherwise(out)).otherwise(none),
        F.when(first.isin("output", "tables", "table"), _all(s, rf"\bout\s*=\s*({_NAME})")).otherwise(none),
        F.when(first == "create", _all(s, rf"^create (?:table|view) ({_NAME})")).when(first == "insert", _all(s, rf"^insert into ({_NAME})")).otherwise(none),
    )


def named_datasets(text: Column) -> tuple[Column, Column]:
    """Names that a statement or several read and write, as they stand there: lists of names, options, tables of SQL and of hash objects."""
    every = statements(text)
    hashed = _all(F.lower(text), rf"\bdataset\s*:\s*['\"]({_NAME})")
    return F.concat(F.flatten(F.transform(every, _reads)), hashed), F.flatten(F.transform(every, _writes))


def datasets(text: Column) -> tuple[Column, Column]:
    """named_datasets(), canonical, sorted, each once."""
    reads, writes = named_datasets(text)
    each = lambda c: F.sort_array(F.array_distinct(F.transform(c, canonical)))
    return each(reads), each(writes)


def canonical(name: Column) -> Column:
    """One-level names get work.; quoted paths are lower-cased with forward slashes; names like _null_ stay."""
    low = F.lower(F.trim(name))
    path = low.rlike("^['\"]")
    return F.when(path, F.replace(low, F.lit("\\"), F.lit("/"))).when(low.rlike(r"^_\w+_$") | F.contains(low, F.lit(".")), low).otherwise(F.concat(F.lit("work."), low))


# ---- documents


def running_headers(pages: DataFrame, doc: str, page: str, text: str, share: float = 0.5, least: int = 3) -> DataFrame:
    """Pages without edge lines that many pages of the document share, and without bare page numbers."""
    lines = pages.select(doc, page, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(doc, page)
    lines = lines.withColumn("edge", (F.col("pos") == 0) | (F.col("pos") == F.max("pos").over(w)))
    total = pages.groupBy(doc).agg(F.count("*").alias("n"))
    common = lines.where("edge").groupBy(doc, "line").agg(F.count_distinct(page).alias("c")).join(total, doc)
    common = common.where(F.col("c") >= F.greatest(F.lit(least), F.floor(F.col("n") * share))).select(doc, "line", F.lit(True).alias("edge"))
    left = lines.join(common, [doc, "line", "edge"], "left_anti").where(~(F.col("edge") & F.trim("line").rlike(r"^\d+$")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return left.groupBy(doc, page).agg(joined.alias("text"))


def tidy(text: Column) -> Column:
    """Straight quotes and dashes, words joined over line breaks, no runs of blanks."""
    plain = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    joined = F.regexp_replace(plain, r"(\w)-\n(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def html_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, section_no, title, body: cut at h1 to h3; what comes first has no title."""
    parts = F.split(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?i)(?=<h[1-3][ >])")
    x = pages.select(key, F.posexplode(parts).alias("section_no", "part"))
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    title = strip(F.regexp_extract("part", r"(?is)^<h[1-3][^>]*>(.*?)</h[1-3]>", 1))
    body = strip(F.regexp_replace("part", r"(?is)^<h[1-3][^>]*>.*?</h[1-3]>", ""))
    return x.select(key, "section_no", title.alias("title"), body.alias("body")).where("title <> '' or body <> ''")


def paragraph_windows(docs: DataFrame, key: str, text: str, most: int = 200, overlap: int = 20) -> DataFrame:
    """key, window_no, text: paragraphs packed to at most `most` words; a long one is split; each window repeats the last words of the one before."""

    def cut(body: str) -> list[str]:
        out, now = [], []
        for para in re.split(r"\n\s*\n", body):
            words = para.split()
            while words:
                room = most - len(now)
                if len(words) <= room:
                    now += words
                    words = []
                elif len(now) > overlap and len(words) <= most - overlap:
                    out.append(now)
                    now = now[-overlap:] if overlap else []
                else:
                    now, words = now + words[:room], words[room:]
                    out.append(now)
                    now = now[-overlap:] if overlap else []
        if now and (not out or now != out[-1][-overlap:]):
            out.append(now)
        return [" ".join(w) for w in out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, w) for k, t in zip(pdf[key], pdf[text], strict=True) for i, w in enumerate(cut(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "window_no", "text"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, window_no int, text string")


def balanced(text: Column) -> Column:
    """Whether brackets and quotes pair up, each closed by its own kind and in order; what is in strings doesn't count."""
    bare = F.regexp_replace(text, r"'[^']*'|\"[^\"]*\"", "")
    marks = F.regexp_extract_all(bare, F.lit(r"[()\[\]{}]"), F.lit(0))
    opens = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{")])

    def step(open_: Column, mark: Column) -> Column:
        wanted = F.try_element_at(opens, mark)
        closed = F.when(F.endswith(open_, wanted), F.left(open_, F.length(open_) - 1)).otherwise("!")
        return F.when(F.startswith(open_, F.lit("!")), open_).when(wanted.isNull(), F.concat(open_, mark)).otherwise(closed)

    return (~bare.rlike("['\"]") & (F.aggregate(marks, F.lit(""), step) == "")).cast("int")


def shortest_suffix(paths: DataFrame, path: str) -> DataFrame:
    """path, name: the shortest end of each path that no other path shares."""
    parts = F.split(F.col(path), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    one = paths.select(path).distinct()
    x = one.withColumn("end", F.explode(ends))
    alone = x.groupBy("end").agg(F.count("*").alias("n")).where("n = 1").select("end")
    best = x.join(alone, "end").groupBy(path).agg(F.min_by("end", F.length("end")).alias("name"))
    return one.join(best, path, "left").select(path, F.coalesce("name", path).alias("name"))


def line_of(body: Column, at: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(body, F.lit(1), at.cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def words(body: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(body), r"\s+"), lambda w: w != ""))


def step_count(body: Column) -> Column:
    """DATA and PROC headers."""
    return F.size(F.filter(statements(body), lambda s: s.rlike(r"^(data|proc)\s")))


def split_oversized(chunks_: DataFrame, key: Sequence[str], text: str, most: int, overlap: int) -> DataFrame:
    """key, part, start, text: texts of more than `most` characters in parts of at most so many, each repeating the last `overlap` of the one before."""
    step_ = most - overlap
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be shorter than a part")
    n = F.length(text)
    last = F.greatest(F.ceil((n - overlap) / step_) - 1, F.lit(0)).cast("int")
    parts = chunks_.select(*key, F.col(text).alias("_body"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return parts.select(*key, "part", (F.col("part") * step_).alias("start"), F.substring("_body", F.col("part") * step_ + 1, F.lit(most)).alias("text"))


OVERLAP_UNITS, OVERLAP_WORDS = 3, 100


def split_steps(found: DataFrame, chunks_: DataFrame, most: int = 700) -> DataFrame:
    """Chunks of more than `most` words in parts that end between statements. found: units(); chunks_: chunks().

    source_id, chunk_no, part, parent, first_unit, last_unit, start_char, end_char, words, text, reads, writes, oversized. Part 0 is the chunk as it
    was; those of an oversized one, 1, 2, ..., have it as their parent and its datasets. A part takes statements while it holds at most `most`
    words (a longer statement stands in a part whole, as does what is repeated before it); each repeats the last statements of the one before,
    OVERLAP_UNITS at most and no more than OVERLAP_WORDS words, one at least. oversized: a part has more than twice `most` words all the same.
    A fold over sorted partitions, which holds one part at a time. The joins are never broadcast: their tables grow with the programs, and estimates
    made before the units are exploded don't tell how far.
    """
    schema = "source_id string, chunk_no int, part int, first_unit int, last_unit int, start_char int, end_char int, words int, text string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, held = None, 0, []
        count = lambda units_: len("".join(u.text for u in units_).split())

        def told() -> tuple:
            return (*key, part, int(held[0].unit_no), int(held[-1].unit_no), int(held[0].start_char), int(held[-1].end_char), count(held), "".join(u.text for u in held))

        def repeated() -> list:
            last, n = [], 0
            for u in reversed(held[-OVERLAP_UNITS:]):
                own = len(u.text.split())
                if last and n + own > OVERLAP_WORDS:
                    break
                last.insert(0, u)
                n += own
            return last

        size = 0  # of what is held, counted anew only where statements touch without white space
        for pdf in batches:
            out = []
            for u in pdf.itertuples(index=False):
                if (u.source_id, u.chunk_no) != key:
                    if held:
                        out.append(told())
                    key, part, held, size = (u.source_id, u.chunk_no), 1, [], 0
                own = len(u.text.split())
                glued = bool(held) and bool(own) and not held[-1].text[-1:].isspace() and not u.text[:1].isspace()
                if held and size + own - glued > most:
                    out.append(told())
                    part += 1
                    held = [*repeated(), u]
                    size = count(held)
                else:
                    held.append(u)
                    size += own - glued
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([told()] if held else [], columns=names)

    reads, writes = datasets(F.col("text"))
    whole = chunks_.withColumn("words", words(F.col("text"))).withColumn("reads", reads).withColumn("writes", writes)
    large = whole.where((F.col("words") > most) & (F.col("first_unit") < F.col("last_unit")))
    wanted = large.select("source_id", "chunk_no", F.explode(F.sequence("first_unit", "last_unit")).alias("unit_no"))
    rows = found.join(wanted.hint("shuffle_merge"), ["source_id", "unit_no"]).select("source_id", "chunk_no", "unit_no", "start_char", "end_char", "text")
    parts = rows.repartition("source_id", "chunk_no").sortWithinPartitions("source_id", "chunk_no", "unit_no").mapInPandas(run, schema)
    parts = parts.join(large.select("source_id", "chunk_no", "reads", "writes").hint("shuffle_merge"), ["source_id", "chunk_no"]).withColumn("parent", F.lit(0))
    every = whole.withColumn("part", F.lit(0)).withColumn("parent", F.lit(None).cast("int"))
    columns = [*names[:3], "parent", *names[3:], "reads", "writes"]
    return every.select(*columns).unionByName(parts.select(*columns)).withColumn("oversized", (F.col("words") > 2 * most) & (F.col("parent").isNotNull() | (F.col("first_unit") == F.col("last_unit"))))


def language(name: Column) -> Column:
    """Case, blanks, dashes and underscores don't count."""
    return F.regexp_replace(F.lower(name), r"[\s_-]", "")


def fences(markdown: Column) -> Column:
    """(language, code) of each fenced block."""
    tags_ = F.regexp_extract_all(markdown, F.lit(r"(?s)```([^\n`]*)\n(.*?)```"), F.lit(1))
    code = F.regexp_extract_all(markdown, F.lit(r"(?s)```([^\n`]*)\n(.*?)```"), F.lit(2))
    return F.arrays_zip(tags_.alias("language"), code.alias("code"))


def headings(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1))


def construct_key(title: Column) -> Column:
    """'SCAN Function' to function:scan; titles of other shapes have none."""
    kind_ = F.lower(F.regexp_extract(title, r"(?i)^(.+?)\s+(function|statement|routine|procedure)s?\b", 2))
    name = F.lower(F.regexp_replace(F.regexp_extract(title, r"(?i)^(.+?)\s+(function|statement|routine|procedure)s?\b", 1), r"^(?i)(the|call)\s+", ""))
    return F.when(kind_ != "", F.concat(kind_, F.lit(":"), name))


def rewrite_paths(programs: DataFrame, key: str, body: str, table: DataFrame) -> DataFrame:
    """Literal paths of LIBNAME, INFILE, FILE and %INCLUDE replaced by the longest mapping; paths with & are counted, not guessed.

    table: source, target. Adds new_text, skipped.
    """
    from quarry.operators.graph import longest_prefix

    found = F.regexp_extract_all(F.col(body), F.lit(r"(?i)\b(?:libname\s+\w+|infile|file|include)\s+['\"]([^'\"]+)['\"]"), F.lit(1))
    paths = programs.select(key, F.explode(F.array_distinct(found)).alias("path"))
    fixed = longest_prefix(paths.where(~F.contains("path", F.lit("&"))), "path", table.withColumn("pair", F.struct("source", "target")), "source", "pair", "to")
    new = F.concat(F.col("to.target"), F.expr("substring(path, length(to.source) + 1)"))
    swaps = fixed.where("to is not null").groupBy(key).agg(F.sort_array(F.collect_set(F.struct(F.length("path").alias("n"), F.col("path"), new.alias("new"))), asc=False).alias("swaps"))
    skipped = paths.where(F.contains("path", F.lit("&"))).groupBy(key).agg(F.count("*").alias("skipped"))
    out = programs.join(swaps, key, "left").join(skipped, key, "left")
    done = F.aggregate(F.coalesce("swaps", F.array()), F.col(body), lambda s, x: F.replace(s, x["path"], x["new"]))
    return out.select(*programs.columns, done.alias("new_text"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def mapping_kind(source: Column) -> Column:
    """How a mapping row is to be used: a path, a two-level name, or a library."""
    return F.when(source.rlike(r"[/\\]|^['\"]"), "by_path").when(F.contains(source, F.lit(".")), "exact").otherwise("by_library")


def python_parses(blocks: DataFrame, key: str, code: str) -> DataFrame:
    """key, ok: whether each code block is Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        def good(c: str | None) -> bool:
            try:
                ast.parse(c or "")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False
            return True

        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ok": [good(c) for c in pdf[code]]})

    return blocks.select(key, code).mapInPandas(run, f"{key} {blocks.schema[key].dataType.simpleString()}, ok boolean")


def merge_sections(sections: DataFrame, by: str, order: str, text: str, most: int) -> DataFrame:
    """by, part, first, n, text: neighbouring sections joined while they hold at most `most` words together; a longer one stands alone."""
    from quarry.operators.retrieval import pack_windows

    packed = pack_windows(sections.select(by, order, F.col(text).alias("_body")).withColumn("_words", words(F.col("_body")).cast("long")), by, order, "_words", most, 1 << 30)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_body"))), lambda x: x["_body"]), "\n\n")
    return packed.groupBy(by, F.col("batch").alias("part")).agg(F.min(order).alias("first"), F.count("*").alias("n"), body.alias("text"))


def rewrite_tables(programs: DataFrame, key: str, body: str, table: DataFrame) -> DataFrame:
    """Adds new_text: table names after FROM (all of a list), JOIN, INTO, TABLE and UPDATE, and those in quotes that are the argument of a
    reader or writer of tables in Python, replaced as `table` (source, target) says; other strings and comments stay.

    Names are compared without case; a name that the mapping doesn't have stays. A body is cut into strings, comments and the rest. Names are first
    replaced by marks, and the marks by the targets, so a target that is itself a source isn't replaced again.
    """
    pieces_ = F.regexp_extract_all(F.col(body), F.lit(r"(?s)/\*.*?(?:\*/|\z)|--[^\n]*|'[^']*(?:''[^']*)*(?:'|\z)|\"[^\"]*(?:\"|\z)|[^'\"/\-]+|."), F.lit(0))
    piece = programs.select(key, F.posexplode(pieces_).alias("pos", "piece"))
    before = F.lag("piece").over(Window.partitionBy(key).orderBy("pos"))
    argument = F.col("piece").rlike(r"^['\"]") & F.coalesce(before.rlike(r"\b(?:table|saveAsTable|insertInto|createOrReplaceTempView)\s*\(\s*\z"), F.lit(False))
    piece = piece.withColumn("argument", argument).withColumn("code", ~F.col("piece").rlike(r"^(/\*|--|'|\")"))
    inside = F.regexp_replace("piece", r"^['\"]|['\"]$", "")
    words_ = F.when(F.col("argument"), F.array(inside)).otherwise(F.regexp_extract_all("piece", F.lit(r"(?<![\w.])[A-Za-z_][\w.]*"), F.lit(0)))
    named = piece.where("code or argument").select(key, F.explode(words_).alias("name")).distinct()
    names = table.select(F.lower("source").alias("_name"), "target").groupBy("_name").agg(F.max("target").alias("target"))
    swaps = named.join(names, F.lower("name") == F.col("_name")).groupBy(key).agg(F.sort_array(F.collect_set(F.struct("name", "target"))).alias("swaps"))
    quoted = lambda x: F.regexp_replace(x, r"([$\\])", r"\\$1")
    mark = lambda k: F.concat(F.lit("\x02"), k.cast("string"), F.lit("\x03"))
    item = r"[\w.\x02\x03]+(?:\s+(?:as\s+)?(?!(?:where|join|left|right|full|inner|cross|on|group|order|having|union)\b)\w+)?"
    numbered = F.transform("swaps", lambda x, k: F.struct(x["name"].alias("name"), x["target"].alias("target"), mark(k).alias("mark")))

    def marked(code: Column, x: Column) -> Column:
        pattern = F.concat(F.lit(rf"(?i)(\b(?:from|join|into|table|update)\s+(?:{item}\s*,\s*)*)\Q"), x["name"], F.lit(r"\E(?![\w.(])"))
        return F.regexp_replace(F.regexp_replace(code, pattern, F.concat(F.lit("$1"), x["mark"])), pattern, F.concat(F.lit("$1"), x["mark"]))

    settled = lambda code, x: F.regexp_replace(code, x["mark"], quoted(x["target"]))
    own = F.filter("swaps", lambda x: x["name"] == inside)
    held = piece.join(swaps.withColumn("swaps", numbered), key, "left")
    new = F.when(F.col("swaps").isNull(), F.col("piece")).when(F.col("code"), F.aggregate("swaps", F.aggregate("swaps", F.col("piece"), marked), settled))
    new = new.when(F.col("argument") & (F.size(own) > 0), F.concat(F.left("piece", F.lit(1)), F.get(own, F.lit(0))["target"], F.right("piece", F.lit(1)))).otherwise(F.col("piece"))
    whole = held.withColumn("piece", new).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("new_text"))
    return programs.join(whole, key, "left").withColumn("new_text", F.coalesce("new_text", body))


@F.pandas_udf(IntegerType())
def _comment_start(bodies: pd.Series) -> pd.Series:
    """Where a comment opens that never closes."""
    mark = re.compile(r"/\*.*?(\*/|\Z)|'(?:[^']|'')*'?|\"(?:[^\"]|\"\")*\"?", re.S)
    return bodies.map(lambda b: next((m.start() for m in mark.finditer(b) if m[0].startswith("/*") and not m[1]), 0)).astype("int32")


def diagnostics(found: DataFrame, programs: DataFrame, source: str = "source_id") -> DataFrame:
    """source_id, code, at: comments that never close, a last statement without its semicolon, macros that never end, and programs without statements. found: units()."""
    low = normalised(F.col("text"))
    open_ = found.where("unclosed_comment").select("source_id", "unit_no", _comment_start("text").alias("_comment"))  # few
    per = found.join(open_, ["source_id", "unit_no"], "left").groupBy("source_id").agg(
        F.min(F.when(F.col("unclosed_comment"), F.col("start_char") + F.col("_comment"))).alias("unclosed_comment"),
        F.min(F.when(~F.col("terminated") & ~F.col("unclosed_comment"), F.col("start_char"))).alias("unterminated"),
        F.when(F.count_if(low.rlike(r"^% ?macro\b")) > F.count_if(low.rlike(r"^% ?mend\b")), F.max(F.when(low.rlike(r"^% ?macro\b"), F.col("start_char")))).alias("open_macro"),
        F.when(F.count_if(~F.col("is_comment")) == 0, F.lit(0)).alias("no_statement"),
    )
    every = programs.select(F.col(source).alias("source_id")).distinct().join(per.withColumn("_met", F.lit(True)), "source_id", "left")
    every = every.withColumn("no_statement", F.when(F.col("_met").isNull(), 0).otherwise(F.col("no_statement")))
    codes = ["unclosed_comment", "unterminated", "open_macro", "no_statement"]
    return every.select("source_id", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("at")) for c in codes])).alias("d")).select("source_id", "d.code", "d.at").where("at is not null")


def cued(text: Column, words_: Sequence[str]) -> Column:
    """Whether any of these words (parts of words, case aside) is in a text."""
    return F.rlike(F.lower(text), F.lit("|".join(re.escape(w.lower()) for w in words_)))
