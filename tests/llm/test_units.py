"""Parts that run without Spark."""

import io
import itertools
import random

import numpy as np
import pytest

from tallyloom.llm import chat, html_text, ngram_join, packing, passages, topk
from tallyloom.llm.common import shingles, word_hashes
from tallyloom.llm.perfect_hash import PerfectHash, build
from tallyloom.llm.token_files import Encoder, TokenFileReader, TokenFileWriter


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 2**63, (n, 2), np.uint64), axis=0)
        assert sorted(PerfectHash(build(keys))(keys).tolist()) == list(range(len(keys)))


def test_words_and_shingles():
    assert len(word_hashes("A b\tC\x1cd  É")) == 3 and not len(word_hashes(None)) and not len(word_hashes(" \n"))
    assert (word_hashes("ABC é") == word_hashes("abc é")).all() and (word_hashes("É") != word_hashes("é")).all()
    w = word_hashes("a b c d e f")
    assert len(shingles(w, 5)) == 2 and len(shingles(w[:3], 5)) == 1 and not len(shingles(w[:0], 5))


def test_similar_sets_always_meet():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.choice([1, 2, 5, 8, 40, 64, 200])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randint(0, n // 5 + 1)):
            if b and rng.random() < 0.6:
                b.discard(next(iter(b)))
            if rng.random() < 0.6:
                b.add(rng.getrandbits(64))
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        keys = [set(np.concatenate([ngram_join.first_blocks(z, band, d) for band, d in ngram_join.homes(len(z), 75)]).tolist()) for z in (x, y)]
        assert keys[0] & keys[1]
        sk = [ngram_join.bit_sketch(z, ngram_join.band_of(len(z))) for z in (x, y)]
        assert ngram_join.hamming(*sk) <= len(a ^ b) <= ngram_join.most_apart(len(a), len(b), 75)


def test_compact_windows_are_the_wide_nodes():
    rng = np.random.default_rng(5)
    for n, width in ((10, 3), (60, 7), (40, 40), (5, 6)):
        v = rng.permutation(n).astype(np.uint64)
        l, c, r = passages.compact_windows(v, width)
        want = []
        for k in range(n):
            a, b = k, k
            while a and v[a - 1] > v[k]:
                a -= 1
            while b + 1 < n and v[b + 1] > v[k]:
                b += 1
            if b - a + 1 >= width:
                want.append((a, k, b))
        assert sorted(zip(l.tolist(), c.tolist(), r.tolist())) == sorted(want)


def test_best_bounds_against_all_choices():
    rng = random.Random(2)
    for _ in range(40):
        x = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        c = [rng.randint(1, 9) for _ in x]
        k = rng.randint(1, 4)
        cost = lambda bs: sum(n * (min(b for b in bs if b >= v) - v) for v, n in zip(x, c))
        best = min(cost([*some, x[-1]]) for size in range(min(k, len(x))) for some in itertools.combinations(x[:-1], size))
        got = packing.best_bounds(np.array(x), np.array(c), k)
        assert len(got) <= k and cost(got) == best
    assert packing.best_bounds(np.zeros(0, int), np.zeros(0, int), 3) == []


def test_templates():
    t = "{% for m in messages %}{% if m.role == 'user' %}U{% elif loop.first %}F{% else %}{{ 'a' + 'b' }}{% endif %}:{% generation %}{{ m.text | upper }}{% endgeneration %};{% endfor %}"
    pieces = list(chat.compile_template(t)(iter([{"role": "user", "text": "x"}, {"role": "bot", "text": "y"}])))
    assert "".join(p for p, _ in pieces) == "U:X;ab:Y;" and "".join(p for p, g in pieces if g) == "XY"
    assert chat.fold(chat.parse("{% if 'a' == 'a' %}x{{ 1 + 2 }}{% else %}y{% endif %}z")) == ("seq", [("text", "x3z")])
    for bad in ("{{ open('x') }}", "{{ m.__class__ }}", "{% for x in y %}{% endfor %}", "{% if a %}", "{{ a | system }}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_escaping_is_reversible():
    rng = random.Random(4)
    render = chat.compile_template(chat.TEMPLATE)
    for _ in range(300):
        turns = [("".join(rng.choices(["a", "\\", "#", "###", ": ", "\n", "</turn>\n", "<", "### "], k=rng.randint(0, 6))), "".join(rng.choices(["\\", "#", "###", "</turn>", "\n", "ü", "<", " ", "### Assistant: "], k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        text = "".join(p for p, _ in render(iter([{"role": r, "text": t} for r, t in turns])))
        cut = rng.randint(0, len(text))
        assert list(chat.read_turns(iter([text[:cut], text[cut:]]))) == turns
    with pytest.raises(ValueError):
        list(chat.read_turns(iter(["### user: no end"])))


def test_token_files():
    file = io.BytesIO()
    writer = TokenFileWriter(file)
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 50_000, int(rng.integers(0, 4000))).astype("<u4").tobytes()) for i in range(120)]
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    reader = TokenFileReader(file)
    assert [(i, ids) for i, _, ids in reader.documents()] == docs and len(reader.frames) > 2
    opened = []
    reader.frame, whole = lambda k: opened.append(k) or whole(k), reader.frame
    assert [(i, ids) for i, _, ids in reader.documents([3, 118])] == [docs[3], docs[118]] and len(opened) == 2
    raw = bytearray(file.getvalue())
    raw[20] ^= 1
    with pytest.raises(Exception):
        list(TokenFileReader(io.BytesIO(bytes(raw))).documents([0]))


def test_pieces_encode_like_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    e = Encoder(public.path("byte_bpe_50k.json"))
    texts = ["", " ", "Hello, world.  Two  spaces\n\n and\ttabs ", "x <|endoftext|> y<|endoftext|>", "don't we're", "日本 語", "a\x1c b", "trail \n", "one. two, three."]
    want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
    assert [e.encode(t) for t in texts] == want and [e.encode(t) for t in texts] == want


def test_blocks_and_chain():
    page = '<html><head><title>T</title><style>x</style></head><body><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>One <b>two</b><br>three.<p>Four &lt;five&gt;.</article><footer>F</footer><script>var a="</p>";</script></body></html>'
    found = html_text.blocks(page)
    assert [t for _, t, _ in found] == ["T", "Home", "A & B", "One two three.", "Four <five>.", "F"]
    pages = [(b, [html_text.marked(p) for p, _, _ in b]) for k in range(30) for v in html_text.variants(page, k) for b in [html_text.blocks(v)]]
    chain = html_text.Chain().train(pages)
    assert [t for (_, t, _), on in zip(found, chain.decode(found)) if on] == ["A & B", "One two three.", "Four <five>."]
    assert html_text.blocks(None) == [] and chain.decode([]) == []
    best = max(itertools.product((0, 1), repeat=len(found)), key=lambda y: chain.first[y[0]] + sum(chain.scores(found)[i, v] for i, v in enumerate(y)) + sum(chain.moves[a, b] for a, b in zip(y, y[1:])))
    assert list(best) == chain.decode(found)


def test_impact_block_is_exact():
    rng = np.random.default_rng(8)
    for n in (1, 6, 500):
        rows = rng.integers(-120, 120, (n, 16))
        rows[n // 2 :] = rows[n // 2]
        block = topk.ImpactBlock(np.arange(n), rows)
        for q in (rows[0], np.zeros(16, int), rng.integers(-120, 120, 16)):
            ids, scores = block.search(0, q, 5)
            want = sorted(((-int(r @ q), i) for i, r in enumerate(rows) if i), key=lambda x: x)[:5]
            assert list(zip((-scores).tolist(), ids.tolist())) == want


def test_pieces_met_again_outlast_a_full_memory(monkeypatch):
    from tallyloom.llm import token_files

    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_files, "PIECES", 40)
    e, asked = Encoder(public.path("byte_bpe_50k.json")), []

    class Counted:
        def __init__(self, model):
            self.model = model

        def tokenize(self, word):
            asked.append(word)
            return self.model.tokenize(word)

    e.model = Counted(e.model)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = [f"q{x}{y}z" for x in letters for y in letters]
    text = " ".join(f"some {word} house." for word in rare)
    whole = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode(text), "<u4").tolist() == whole
    assert asked.count("Ġsome") == asked.count("Ġhouse") == 1 and len(e) + len(e.former) <= 80
    for odd in ("a.\nB c", "a\n\nB", " a  b", "a \nb", "x\0 y", "\n", "it's\tso\n", "<|endoftext|>\nA b"):
        assert np.frombuffer(e.encode(odd), "<u4").tolist() == e.tokenizer.encode(odd, add_special_tokens=False).ids
