"""Documents of triples, read by many tasks: RDF/XML cut at its top-level elements, N-Triples at its lines.

An RDF/XML file is scanned as text in Spark's own splits. Where a split begins, nobody knows
whether it lies in a comment or how many elements are open. So

1. each split tells, for every lexical state that it may begin in, the state in which it ends
   and how many elements it opens; the first split also gives the document's head, from its
   beginning to the root's start tag;
2. these maps are put together along each file (a row for each split and state), so that state
   and number of open elements are known where each split begins;
3. each split is read again: its whole top-level elements are parsed below the document's head,
   many at once; what it holds of an element that another split begins or ends is a fragment;
4. fragments meet by the split that begins their element, some two a split, and are parsed as well.

Defined results: blank nodes are named after file, split and place, those with a label after
file and label; an empty file has no triples; documents in other encodings than UTF-8 go through
``owl.read_triples(spark, path, split=False)``; a malformed element raises.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import RDF, GraphError
from ..session import saved, saved_rows, shipped

#: Characters of text that a task handles at once, about.
CHUNK = 1 << 20
#: Characters of document heads and splits that are broadcast at most.
MOST_HEADS = 4 << 20
#: Lexical states at a place behind a ">": between tags, in a comment, character data, an instruction, a quoted value of a tag, a document type.
TEXT, COMMENT, DATA, INSTRUCTION, DOUBLE, SINGLE, TYPE = range(7)
ENDS = {COMMENT: "-->", DATA: "]]>", INSTRUCTION: "?>", DOUBLE: '"', SINGLE: "'"}
_REST = r"""[^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>"""
REST = re.compile(_REST)
TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<[^!?]" + _REST, re.S)
QUOTED = re.compile(r""""[^"]*"|'[^']*'|["']""")
#: A document type ends behind its declarations, if it has any in brackets.
TYPE_REST = re.compile(r"\]\s*>")
TYPE_END = re.compile(r"""<!(?:[^\[\]"'>]|"[^"]*"|'[^']*')*(?:\[(?:[^\]"'<]|"[^"]*"|'[^']*'|<!--.*?-->|<\?.*?\?>|<)*\]\s*)?>""", re.S)
ENCODING = re.compile(r"""(<\?xml[^>]*encoding\s*=\s*)(?:"[^"]*"|'[^']*')""")
OPENED = (("<!--", COMMENT), ("<![CDATA[", DATA), ("<?", INSTRUCTION), ("<!", TYPE))

CHUNKS = "path string, start long, seq long, text string"
SUMMARY = "path string, start long, state int, last int, opened long, head string"
FOUND = "s string, p string, o string, literal boolean, lang string, datatype string, path string, start long, part int, text string"


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, seq, text): the splits of all files as runs of text that end behind a ``>``."""

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, size, seq = None, [], 0, 0
        for batch in batches:
            for file, start, value in zip(batch["path"], batch["start"], batch["value"], strict=True):
                if held and (key != (file, start) or size > CHUNK):
                    yield pd.DataFrame([(*key, seq, ">".join(held) + ">")], columns=["path", "start", "seq", "text"])
                    held, size, seq = [], 0, seq + 1
                if key != (file, start):
                    key, seq = (file, start), 0
                held.append(value)
                size += len(value) + 1
        if held:
            yield pd.DataFrame([(*key, seq, ">".join(held) + ">")], columns=["path", "start", "seq", "text"])

    shipped(spark)
    rows = spark.read.option("lineSep", ">").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value").mapInPandas(gathered, CHUNKS)


def _open_quote(text: str) -> int:
    """State of a tag's beginning that has a value open."""
    left = next((x for x in QUOTED.findall(text) if len(x) == 1), '"')
    return SINGLE if left == "'" else DOUBLE


def tokens(text: str, state: int) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, elements opened, state behind it) of each piece of markup; the last one may be open to the end of the text.

    ``text`` ends behind a ``>``, so markup that is open there has a ``>`` within it. The first
    piece begins at 0 if the state is not ``TEXT``.
    """
    at = 0
    if state != TEXT:
        opened, end = 0, -1
        if state == TYPE:
            found = TYPE_REST.search(text)
            end = found.end() if found else -1
        else:
            end = text.find(ENDS[state])
            end = end + len(ENDS[state]) if end >= 0 else -1
            if end >= 0 and state in (DOUBLE, SINGLE):
                rest = REST.match(text, end)
                if rest is None:  # another value is open
                    state, end = _open_quote(text[end:]), -1
                else:
                    end = rest.end()
                    opened = 0 if text[end - 2] == "/" else 1
        if end < 0:
            yield 0, len(text), 0, state
            return
        yield 0, end, opened, TEXT
        at = end
    while (begin := text.find("<", at)) >= 0:
        found = TOKEN.match(text, begin)
        if found is None and text.startswith("<!", begin) and not text.startswith(("<!--", "<![CDATA["), begin):
            found = TYPE_END.match(text, begin)
        if found is None:
            state = next((k for opening, k in OPENED if text.startswith(opening, begin)), None)
            yield begin, len(text), 0, _open_quote(text[begin:]) if state is None else state
            return
        at = found.end()
        if text[begin + 1] in "!?":
            yield begin, at, 0, TEXT
        else:
            yield begin, at, -1 if text[begin + 1] == "/" else 0 if text[at - 2] == "/" else 1, TEXT


def _moved(text: str, state: int) -> tuple[int, int]:
    """State and elements opened at the end of the text."""
    opened = 0
    for _, _, more, after in tokens(text, state):
        state, opened = after, opened + more
    return state, opened


def head_of(text: str) -> str | None:
    """The text up to the end of the first start tag, if it holds one."""
    return next((text[:end] for _, end, opened, state in tokens(text, TEXT) if opened == 1 and state == TEXT), None)


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, ways, head, found = None, {}, None, None

    def told() -> Iterator[pd.DataFrame]:
        if key:
            rows = [(*key, first, last, opened, found if first == TEXT else None) for first, (last, opened) in ways.items()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])

    for batch in batches:
        for path, start, text in zip(batch["path"], batch["start"], batch["text"], strict=True):
            if key != (path, start):
                yield from told()
                key, found, head = (path, start), None, "" if start == 0 else None
                ways = {k: (k, 0) for k in ([TEXT] if start == 0 else range(7))}
            moved = {state: _moved(text, state) for state in {last for last, _ in ways.values()}}
            ways = {k: (moved[last][0], opened + moved[last][1]) for k, (last, opened) in ways.items()}
            if head is not None:
                head += text
                found = head_of(head)
                head = None if found else head
    yield from told()


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """State and open elements at each split of one file, from what each does to any state: a row for each split and state."""
    out, state, opened = [], TEXT, 0
    head = next((x for x in rows["head"] if isinstance(x, str)), "")
    if not head:
        raise GraphError("document", f"no element begins in the first split of {rows['path'].iloc[0]}")
    head = ENCODING.sub(r'\1"UTF-8"', head, count=1)
    for start, part in rows.groupby("start", sort=True):
        out.append((rows["path"].iloc[0], start, state, opened, head))
        own = part.set_index("state").loc[state]
        state, opened = int(own["last"]), opened + int(own["opened"])
    return pd.DataFrame(out, columns=["path", "start", "state", "open", "head"])


def _level(head: str) -> int:
    """Open elements around a top-level one: the root, if it only holds the others."""
    return 1 if re.match(r"(?:[\w.-]+:)?RDF[\s>]", head[head.rfind("<") + 1 :]) else 0


def _document(head: str, elements: str) -> bytes:
    """The elements below their document's head."""
    root = head.rfind("<")
    if not _level(head):
        return (head[:root] + elements).encode()
    return f"{head}{elements}</{re.match(r'[^\s/>]+', head[root + 1 :])[0]}>".encode()


def element_reader(triples_of: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Triples of the whole top-level elements of splits, and fragments of the others."""
    columns = [c.split()[0] for c in FOUND.split(", ")]

    def parsed(head: str, path: str, start: int, turn: int, elements: list[str]) -> pd.DataFrame:
        rows = triples_of(_document(head, "".join(elements)), path.rsplit("/", 1)[-1], f"{start}.{turn}.")
        return pd.DataFrame([(*x, None, None, None, None) for x in rows], columns=columns)

    def fragment(key: tuple[str, int], part: int, text: str) -> pd.DataFrame:
        return pd.DataFrame([(None,) * 6 + (*key, part, text)], columns=columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # inside: in a top-level element, of which ``held`` are the texts of earlier chunks; whole: it began in this split.
        key, held, inside, whole = None, [], False, True
        for batch in batches:
            for path, start, text, state, opened, head in zip(*(batch[c] for c in ("path", "start", "text", "state", "open", "head")), strict=True):
                if key != (path, start):
                    if held:
                        yield fragment(key, 0 if whole else 1, "".join(held))
                    key, depth, lexical, level, turn = (path, start), int(opened), int(state), _level(head), 0
                    inside = depth > level or lexical in (DOUBLE, SINGLE)
                    held, whole = [], not inside
                    prolog = level == 1 and start == 0  # until the root's start tag is read
                begin, done = 0, []
                for p, q, more, after in tokens(text, lexical):
                    in_value, lexical = lexical in (DOUBLE, SINGLE), after
                    depth += more
                    if prolog:
                        prolog = depth == 0
                    elif not inside:
                        if more == 1 or after in (DOUBLE, SINGLE):
                            inside, whole, begin = True, True, p
                        elif more == 0 and after == TEXT and text[p + 1] not in "!?":
                            done.append(text[p:q])
                    elif after == TEXT and depth == level and (more == -1 or in_value):
                        held.append(text[begin:q])
                        if whole:
                            done.append("".join(held))
                        else:
                            yield fragment(key, 2, "".join(held))
                        inside, held = False, []
                if inside:
                    held.append(text[begin:])
                if done:
                    yield parsed(head, *key, turn, done)
                    turn += 1
        if held:  # the element goes on in the next split
            yield fragment(key, 0 if whole else 1, "".join(held))

    return read


def read_split(spark: SparkSession, path: str, triples_of: Callable) -> DataFrame:
    """Triples of all RDF/XML files of a path, each read by as many tasks as it has splits."""
    found = chunks(spark, path)
    splits = found.mapInPandas(_summaries, SUMMARY).groupBy("path").applyInPandas(_composed, "path string, start long, state int, open long, head string")
    splits = saved(splits)
    size = splits.agg(F.sum(F.length("head") + F.length("path") + 24)).first()[0] or 0
    if size <= MOST_HEADS:
        rows = found.join(F.broadcast(splits), ["path", "start"])
    else:
        rows = found.join(splits.hint("merge"), ["path", "start"]).sortWithinPartitions("path", "start", "seq")
    read = saved(rows.select("path", "start", "text", "state", "open", "head").mapInPandas(element_reader(triples_of), FOUND))
    triples = read.where("text is null").select("s", "p", "o", "literal", "lang", "datatype")
    # Fragments of one element follow one another: part 0 begins it, 2 ends it, 1 is a whole split of it.
    begins = F.last(F.when(F.col("part") == 0, F.col("start")), ignorenulls=True).over(Window.partitionBy("path").orderBy("start", F.col("part") == 0))
    pieces = read.where("text is not null").withColumn("begin", begins)
    heads = splits.where("start = 0").select("path", "head")
    order = F.array_sort(F.collect_list(F.struct("start", F.col("part") == 0, "text")))
    whole = pieces.groupBy("path", "begin").agg(F.array_join(order["text"], "").alias("text")).join(heads, "path")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, begin, text, head in zip(*(batch[c] for c in ("path", "begin", "text", "head")), strict=True):
                rows = list(triples_of(_document(head, text), path.rsplit("/", 1)[-1], f"{begin}.f."))
                yield pd.DataFrame(rows, columns=["s", "p", "o", "literal", "lang", "datatype"])

    return triples.union(whole.mapInPandas(parse, "s string, p string, o string, literal boolean, lang string, datatype string"))


NODE = r"(?:<([^>]*)>|(_:\S+))"
LINE = rf'^\s*{NODE}\s+<([^>]*)>\s+(?:{NODE}|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.'
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))")
LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else LETTERS.get(m[3], m[3]), text)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all N-Triples files of a path; lines that are no triple raise, but for blank ones and comments."""
    shipped(spark)
    plain = F.pandas_udf(lambda texts: texts.map(lambda x: unescaped(x) if x else x), "string")
    lines = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("file"))
    lines = lines.where(~F.regexp_like("value", F.lit(r"^\s*(#.*)?$")))
    part = lambda k: F.regexp_extract("value", LINE, k)
    fitting = F.when(F.regexp_like("value", F.lit(LINE)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.substring("value", 1, 200))).cast("boolean"))
    rows = lines.where(fitting).select("file", *(part(k + 1).alias(c) for k, c in enumerate(("s", "sb", "p", "o", "ob", "text", "lang", "datatype"))))
    clean = lambda c: F.when(F.contains(F.col(c), F.lit("\\")), plain(c)).otherwise(F.col(c))
    blank = lambda c: F.concat(F.lit("_:"), "file", F.lit("/"), F.substring(c, 3, 1 << 30))
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    literal = (F.col("o") == "") & (F.col("ob") == "")
    return rows.select(
        F.when(F.col("sb") != "", blank("sb")).otherwise(clean("s")).alias("s"),
        clean("p").alias("p"),
        F.when(F.col("ob") != "", blank("ob")).when(F.col("o") != "", clean("o")).otherwise(clean("text")).alias("o"),
        literal.alias("literal"),
        empty("lang").alias("lang"),
        empty("datatype").alias("datatype"),
    )


def with_members(triples: DataFrame, member: str) -> DataFrame:
    """Lists written as chains of first and rest become (list, member, item); the way from a cell to its list is halved each round."""
    is_cell = (F.col("p") == f"{RDF}rest") & (F.col("o") != f"{RDF}nil")
    up, n = saved_rows(triples.where(is_cell).select(F.col("o").alias("cell"), F.col("s").alias("up")))
    moved = n
    while moved:
        above = up.select(F.col("cell").alias("up"), F.col("up").alias("top"))
        up, moved = saved_rows(up.join(above.hint("merge"), "up", "left").select("cell", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("new")), "new")
        up = up.select("cell", "up")
    first = triples.where(F.col("p") == f"{RDF}first").join(up.select(F.col("cell").alias("s"), "up").hint("merge"), "s", "left")
    items = first.select(F.coalesce("up", "s").alias("s"), F.lit(member).alias("p"), *("o literal lang datatype".split()))
    return triples.where(~F.col("p").isin(f"{RDF}first", f"{RDF}rest")).unionByName(items)
