"""Cross-tokenizer alignment, language identification and the Merkle manifest against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphmill.llm import alignment, languages, merkle, textbytes
from graphmill.llm.common import shipped

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def rows():
    rng = random.Random(3)
    alphabet = list(" \n\tab'é日 　▁<|>0x4\x85\x1f!1,😀éΩ")
    texts = [None, "", " ", "a ", "a  b", "a▁b", "x\x00y", "<|endoftext|> and <0x41> <s></s>", "é è", "日本 語 a", "don't  we'll 12 345", "one", "x" * 3000, "123 !?", "Ünd"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    english, german = "the cat and the dog of this house with ", "der hund und die katze von diesem haus mit "
    texts += [english * 5, german * 5, english * 6 + german * 6, german * 9 + english * 4, "The DOG", "und"] * 3
    found = [(k * 7 % 331, t, ("en", "de", None)[k % 3], (None, "s1", "s2", "ß", "s10")[k % 5], None if k % 9 == 0 else len(t or ""), "x") for k, t in enumerate(texts)]
    for k, t in enumerate([english * 4, german * 4] * 12):
        found.append((1000 + k, t, "en" if t[0] == "t" else "de", f"t{k % 2}", len(t), "y"))
    return [*found, (None, "A text without an id", "en", "s1", 3, None), (None, None, None, None, None, None), found[20], found[20], (7, "Another TEXT of one id", "en", "s1", 5, "z")]


@pytest.fixture(scope="module")
def tables(spark):
    shipped(spark)
    return {"edge": spark.createDataFrame(rows(), DOCS).repartition(3), "real": spark.read.parquet(f"{SF}/documents.parquet")}


NAMES = ["edge", "real"]


def aligned(texts):
    """Alignment by its definition, on whole texts."""
    folder = alignment.TOKENIZERS
    a, b = Tokenizer.from_file(f"{folder}/{alignment.A_FILE}"), sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{alignment.B_FILE}")
    a.encode_special_tokens = True
    letters, found = alignment.byte_letters(), []
    for text in texts:
        found.append(([], [], [], []))
        if not text:
            continue
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(letters[c] for c in a.id_to_token(k)) for k in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in b_ids]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups = []
        for lo, hi in zip([0, *(cuts := sorted(set(a_ends) & set(b_ends)))], cuts, strict=False):
            own = [",".join(str(k) for k, e in zip(ids, ends, strict=True) if lo < e <= hi) for ids, ends in ((a_ids, a_ends), (b_ids, b_ends))]
            groups.append("|".join(own))
        links = [
            (x, y)
            for x, e, s in zip(a_ids, a_ends, [0, *a_ends], strict=False)
            for y, f, t in zip(b_ids, b_ends, [0, *b_ends], strict=False)
            if max(s, t) < min(e, f)
        ]
        found[-1] = (a_ids, b_ids, groups, links)
    count = Counter(pair for *_, links in found for pair in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [
        (len(p), len(q), len(g), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for p, q, g, links in found
    ]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("name", NAMES)
def test_alignment(tables, monkeypatch, name, broadcast):
    docs = tables[name] if name == "edge" else tables[name].where("length(text) < 1500")  # the plain way is quadratic in a text
    if not broadcast:
        monkeypatch.setattr(alignment, "MOST_PAIRS", -1)
    monkeypatch.setattr(alignment, "MOST_KNOWN", 500)
    found = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(found, aligned([r["text"] for r in found]), strict=True))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = alignment.align(docs)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == want
    assert set(got.columns) == set(names) and sum(x[1] > 0 for x in want) > 20


def test_ends_rank_and_select():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (0, 1, 63, 64, 65, 400):
        a = rng.integers(1, 4, n)
        b = rng.permutation(a)  # other cuts of as many bytes
        ends, other = alignment.Ends(a), alignment.Ends(b)
        places = np.arange(int(a.sum()) + 1)
        assert ends.select().tolist() == np.cumsum(a).tolist()
        assert ends.rank(places).tolist() == [int((np.cumsum(a) <= p).sum()) for p in places]
        if n:
            assert (ends & other).select().tolist() == sorted(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))


def test_chunks_tokenise_as_whole_texts():
    """Every character beside letters and spaces: cuts between chunks change no token."""
    chunks = alignment.Chunks(alignment.TOKENIZERS)
    rng = random.Random(9)
    characters = [chr(c) for c in [*range(1, 0x250), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600]]
    texts = [f"a{c} b {c}c{rng.choice(characters)} {c} d" for c in characters]
    data, off = textbytes.buffer_of(pa.array(texts))
    doc, chunk = chunks.read(data, off)
    for k, want in enumerate(aligned(texts)):
        mine = chunk[doc == k].tolist()
        assert (sum(chunks.numbers["n_a"][c] for c in mine), sum(chunks.numbers["n_b"][c] for c in mine)) == want[:2], texts[k]
        assert hashlib.sha256(b";".join(chunks.groups[c] for c in mine)).hexdigest() == want[-1] or not mine and not want[-1]


def grams_of(text):
    words = "".join(c if b"a" <= c.encode()[:1] <= b"z" or ord(c) > 127 else " " for c in text.lower()).split(" ")
    words = [w for w in words if w]
    raw = ("  " + "".join(w + " " for w in words)).encode()
    hashed = lambda g: int(textbytes.mix(np.array([int.from_bytes(g, "little") + 0x9E3779B97F4A7C15], np.uint64))[0]) >> 46
    return Counter(hashed(raw[k : k + 4]) for k in range(len(raw) - 3)) if words else Counter()


def predicted(text, langs, chance, prior):
    """Forward choice of the set of languages, each set's proportions by many rounds."""
    known = {g: n for g, n in grams_of(text).items() if g in chance}
    if not known:
        k = max(range(len(langs)), key=lambda j: prior[j])
        return langs[k], math.exp(prior[k])
    total = sum(known.values())

    def likelihood(members, share):
        return sum(n * math.log(sum(s * chance[g][k] for k, s in zip(members, share, strict=True))) for g, n in known.items())

    def worth(k):
        return likelihood([k], [1.0]) / languages.GRAM + prior[k]

    first = max(range(len(langs)), key=worth)
    members, share, reached = [first], [1.0], likelihood([first], [1.0])
    while len(members) < len(langs):
        rise = {}
        for k in set(range(len(langs))) - set(members):
            rise[k] = sum(n * chance[g][k] / sum(s * chance[g][m] for m, s in zip(members, share, strict=True)) for g, n in known.items()) / total
        more = [*members, max(sorted(rise), key=rise.get)]
        trial = [1 / len(more)] * len(more)
        for _ in range(languages.FEW + languages.ROUNDS):
            parts = {g: [s * chance[g][k] for k, s in zip(more, trial, strict=True)] for g in known}
            trial = [sum(n * parts[g][j] / sum(parts[g]) for g, n in known.items()) / total for j in range(len(more))]
        value = likelihood(more, trial)
        if value - reached <= languages.GRAM * (0.5 * math.log(total / languages.GRAM + 1) + math.log(len(langs))):
            break
        members, share, reached = more, trial, value
    top = min(range(len(members)), key=lambda j: (-share[j], members[j]))
    against = sum(math.exp(worth(k) - (reached / languages.GRAM + prior[members[top]])) for k in range(len(langs)) if k not in members)
    return langs[members[top]], share[top] / (1 + against)


@pytest.mark.parametrize("name", NAMES)
def test_languages(tables, name):
    docs = tables[name] if name == "edge" else tables[name].where("doc_id % 3 = 0")
    found = docs.select("doc_id", "text", "lang").collect()
    fold = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 4
    counts = defaultdict(Counter)
    for d, t, lang in found:
        if t is not None and lang is not None and fold(d) not in (None, 2):
            counts[lang] += grams_of(t)
    langs = sorted(counts)
    every, total = sum(counts.values(), Counter()), {x: sum(c.values()) for x, c in counts.items()}
    common = {g: languages.SMOOTHING * n / sum(every.values()) for g, n in every.items()}
    chance = {g: [(counts[x][g] + common[g]) / (total[x] + languages.SMOOTHING) for x in langs] for g in every}
    prior = [math.log((total[x] + 1) / (sum(total.values()) + len(langs))) for x in langs]
    want = Counter()
    close = {}
    for d, t, _ in found:
        lang, score = predicted(t, langs, chance, prior) if t and any(c.isalpha() for c in t) else ("und", 0.0)
        want[d, fold(d) == 2, lang] += 1
        close[d, t] = score
    got = languages.identify(docs, languages.fit(docs))
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"]) for r in got.collect()) == want
    scores = got.groupBy("doc_id").agg({"score": "sum"}).collect()
    wanted = Counter()
    for d, t, _ in found:
        wanted[d] += close[d, t]
    assert all(abs(r["sum(score)"] - wanted[r["doc_id"]]) < 1e-3 for r in scores)
    assert len(langs) >= 2


def test_languages_of_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages.identify(docs, languages.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "1 2 3", None)], "doc_id long, text string, lang string")
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in languages.identify(docs, languages.fit(docs)).collect()} == {(k, "und", 0.0) for k in (1, 2, 3)}


def test_mixture_of_two_languages():
    words = {"aa": "ka ki ko ku ke ", "bb": "sta ste sto stu sti ", "cc": "mor mir mar mur mer "}
    names, counts = sorted(words), []
    for x in names:
        data, off = textbytes.buffer_of(pa.array([words[x] * 50]))
        _, bucket, n = languages.grams(data, off, 12)
        counts.append(np.bincount(bucket, weights=n, minlength=1 << 12))
    model = languages.model_of(names, counts, 12)
    data, off = textbytes.buffer_of(pa.array([words["aa"] * 9 + words["cc"] * 12, words["bb"] * 4, "", words["cc"]]))
    best, score = languages.mixtures(model, *languages.grams(data, off, 12), 4)
    assert [names[k] for k in best[[0, 1, 3]]] == ["cc", "bb", "cc"] and 0.5 < score[0] < 0.7 and score[1] > 0.99
    assert languages.bits_for(4) == 18 and languages.bits_for(65) == 17 and languages.bits_for(1 << 24) == 0


def manifest(found):
    """Hash trees by their definition, held in lists."""
    digest = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, t: digest(*(value(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], t)))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    def way(tree, k):
        for level in tree[:-1]:
            yield level[k // 16 * 16 : k], level[k + 1 : k // 16 * 16 + 16]
            k //= 16

    by = defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for s in names}
    trees = {s: levels([leaf(r, r["text"]) for r in ordered[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for n, s in enumerate(names):
        for k, r in enumerate(ordered[s]):
            steps = [*way(trees[s], k), *way(top, n)]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            h = leaf(r, lower(r["text"]) if tampered else r["text"])
            for before, after in steps:
                h = digest(*before, h, *after)
            root = top[-1][0]
            yield r["doc_id"], trees[s][0][k], trees[s][-1][0], root, digest(*(x for a, b in steps for x in a + b)), h, h == root


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("name", NAMES)
def test_manifest(tables, name):
    got = merkle.manifest(tables[name]).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == Counter(manifest(tables[name].collect()))


def test_manifest_of_many_sizes(spark):
    """Sources at and around the fanout's powers, one over several partitions, and more sources than the fanout."""
    sizes = [1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 600, *[1] * 10]
    found = [(100 * k + j * 7, f"Text {j}", "en", f"s{k}", j, None) for k, n in enumerate(sizes) for j in range(n)]
    docs = spark.createDataFrame(found, DOCS).repartition(5)
    got = merkle.manifest(docs).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == Counter(manifest(docs.collect()))
    assert merkle.manifest(docs.limit(0)).count() == 0 and merkle.manifest(docs.limit(1)).count() == 1
