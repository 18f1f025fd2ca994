"""Documents read by many tasks against the same documents read by one."""

import random
from collections import Counter

import pandas as pd
import pytest

from graphmill.model import GraphError
from graphmill.sources import documents, owl

HEAD = """<?xml version='1.0' encoding="ISO-8859-1"?>
<!-- a comment > with <tags> & more -->
<!DOCTYPE rdf:RDF [ <!ENTITY owl "http://www.w3.org/2002/07/owl#"> <!ENTITY x 'a>b'> <!-- in > here --> ]>
<rdf:RDF xmlns="http://x.org/o#" xmlns:o="http://x.org/o#" xml:base="http://x.org/o" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
  xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">"""
PARTS = (
    '<owl:Class rdf:about="#C{k}"><rdfs:label>name > {k}</rdfs:label><rdfs:subClassOf rdf:resource="#C{j}"/></owl:Class>',
    "<owl:Class rdf:about='#D{k}' rdfs:label='a > \"quoted\" > label'/>",
    '<!-- <owl:Class rdf:about="#no"> > --><!---->',
    '<rdf:Description rdf:about="#E{k}"><note><![CDATA[ <b> > ]] > ]]></note><?do it > now?></rdf:Description>',
    '<owl:Class rdf:about="#F{k}"><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="&owl;p{j}"/><owl:someValuesFrom rdf:resource="#C{k}"/>'
    "</owl:Restriction></rdfs:subClassOf><!-- > --></owl:Class>",
    '<owl:Class rdf:about="#G{k}"><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="#C1"/><owl:Class><owl:complementOf rdf:resource="#C2"/></owl:Class>'
    "</owl:unionOf></owl:Class>",
    '<rdf:Description rdf:nodeID="n{j}" note="x>y&lt;z"/>', "\n  ", "<owl:Class\n rdf:about = '#H{k}' ><note rdf:parseType='Literal'>x <b c='>'>y</b></note></owl:Class >",
)


def document(rng, n):
    return HEAD + "".join(rng.choice(PARTS).format(k=k, j=rng.randrange(n)) for k in range(n)) + "\n</rdf:RDF>\n"


def alike(triples):
    """Triples with blank nodes named after what is around them."""
    triples = set(triples)
    blank = lambda x: x.startswith("_:") if x else False
    names = {x: "_" for t in triples for x in (t[0], t[2]) if blank(x) and not t[3] or blank(t[0]) and x == t[0]}
    for _ in range(4):
        around = {x: [] for x in names}
        for s, p, o, *rest in triples:
            if s in names:
                around[s].append(("s", p, names.get(o, o), *map(str, rest)))
            if o in names and not rest[0]:
                around[o].append(("o", p, names.get(s, s), *map(str, rest)))
        names = {x: f"_{hash(tuple(sorted(map(str, v))))}" for x, v in around.items()}
    return Counter((names.get(s, s), p, o if rest[0] else names.get(o, o), *rest) for s, p, o, *rest in triples)


def read_in_splits(text, cuts, chunk):
    """The steps of ``read_split`` on splits that begin behind some of the ``>``."""
    pieces = [x + ">" for x in text.split(">")]
    rows, start = [], 0
    for p, q in zip([0, *cuts], [*cuts, len(pieces)], strict=True):
        part = pieces[p:q]
        rows += [("file:/f.owl", start, k, "".join(part[k : k + chunk])) for k in range(0, len(part), chunk)]
        start += sum(map(len, part))
    found = pd.DataFrame(rows, columns=["path", "start", "seq", "text"])
    splits = documents._composed(pd.concat(documents._summaries(iter([found]))))
    out = pd.concat(documents.element_reader(owl.triples_of)(iter([found.merge(splits, on=["path", "start"])])), ignore_index=True)
    triples = [tuple(None if x is None or x != x else x for x in r) for r in out[out["text"].isna()][["s", "p", "o", "literal", "lang", "datatype"]].itertuples(index=False)]
    open_text, head = None, splits["head"][0]
    for r in out[out["text"].notna()].sort_values(["start", "part"], key=lambda c: c if c.name == "start" else c == 0).itertuples():
        assert (r.part == 0) == (open_text is None)
        open_text = (open_text or "") + r.text
        if r.part == 2:
            triples += owl.triples_of(documents._document(head, open_text), "f.owl", f"{r.start}.f.")
            open_text = None
    assert open_text is None
    return triples


def test_any_splits_give_the_same_triples():
    rng = random.Random(2)
    for _ in range(60):
        text = document(rng, rng.randrange(1, 25))
        want = alike(owl.triples_of(text.replace("ISO-8859-1", "UTF-8").encode(), "f.owl"))
        n = text.count(">") + 1
        first = HEAD.count(">")
        cuts = sorted(rng.sample(range(first, n), min(n - first, rng.choice([0, 1, 2, 5, 60]))))
        assert alike(read_in_splits(text, cuts, rng.choice([1, 2, 7, 1000]))) == want, (text, cuts)
    single = "<owl:Class xmlns:owl='http://www.w3.org/2002/07/owl#' xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' rdf:about='http://x/A'><owl:p>x</owl:p></owl:Class>"
    assert alike(read_in_splits(single, [2], 1)) == alike(owl.triples_of(single.encode(), "f.owl"))


def rows(df):
    return [tuple(r) for r in df.select("s", "p", "o", "literal", "lang", "datatype").collect()]


def test_files_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    for k in range(3):
        (tmp_path / f"{k}.owl").write_text(document(rng, 20 + 200 * k), encoding="ascii")
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert documents.chunks(spark, str(tmp_path)).select("path", "start").distinct().count() > 10
        got = alike(rows(owl.read_triples(spark, str(tmp_path))))
        monkeypatch.setattr(documents, "MOST_HEADS", -1)
        assert alike(rows(owl.read_triples(spark, str(tmp_path)))) == got
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    want = alike(rows(owl.read_triples(spark, str(tmp_path), split=False)))
    assert got == want and len(want) > 500
    names = owl.shred(owl.read_triples(spark, str(tmp_path)))["namespace"].collect()
    assert ("http://x.org/o#", "o") in {(r["url"], r["prefix"]) for r in names}


def test_lines_of_triples(spark, tmp_path):
    lines = [
        "# a comment", "", "<http://x/A> <http://x/p> <http://x/B> .", '<http://x/A> <http://x/p> "a \\"b\\" \\u00e9\\n" .', '_:a <http://x/p> "hi"@en-GB .',
        '<http://x/A> <http://x/q> "4"^^<http://www.w3.org/2001/XMLSchema#int> .  ', "<http://x/A> <http://x/list> _:l0 .",
    ]
    first, rest = f"<{owl.RDF}first>", f"<{owl.RDF}rest>"
    lines += [f"_:l{k} {first} <http://x/i{k}> ." for k in range(9)] + [f"_:l{k} {rest} {f'_:l{k + 1}' if k < 8 else f'<{owl.RDF}nil>'} ." for k in range(9)]
    (tmp_path / "a.nt").write_text("\n".join(lines), encoding="utf-8")
    got = rows(owl.read_triples(spark, str(tmp_path / "a.nt")))
    assert Counter(got) == Counter(
        [
            ("http://x/A", "http://x/p", "http://x/B", False, None, None), ("http://x/A", "http://x/p", 'a "b" é\n', True, None, None),
            ("_:a.nt/a", "http://x/p", "hi", True, "en-GB", None), ("http://x/A", "http://x/q", "4", True, None, "http://www.w3.org/2001/XMLSchema#int"),
            ("http://x/A", "http://x/list", "_:a.nt/l0", False, None, None), *(("_:a.nt/l0", owl.MEMBER, f"http://x/i{k}", False, None, None) for k in range(9)),
        ]
    )
    (tmp_path / "b.nt").write_text("<http://x/A> is bad .\n")
    with pytest.raises(Exception, match="not a triple"):
        owl.read_triples(spark, str(tmp_path / "b.nt")).collect()


def test_a_document_without_elements(spark, tmp_path):
    (tmp_path / "a.owl").write_text("<!-- nothing -->")
    with pytest.raises(Exception, match="no element"):
        owl.read_triples(spark, str(tmp_path)).collect()
    assert issubclass(GraphError, Exception)
