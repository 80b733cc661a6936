"""Per-text kernels against brute force."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidegrid.llm import automaton, chat, chunks, cover, languages, near, packing, pages, quality, secrets, sharding

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "   ", "a", "  two  spaces ", "▁x ▁▁ y", "\n\t x", "é😀 😀 ​", "a\0b", "<s> </s> <unk> <0x0A>", "x" * 3000,
       "a\n b", "a  b c d\x1c e <|endoftext|> f", "it's  'll", "a 　 b", "日本語 テキスト"]


def test_pieces_equal_the_library():
    chunks.check_model(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table, pieces = chunks.ChunkTable(PIECES, bound=10), chunks.PieceTable(PIECES)
    for text in ODD:
        want = sp.encode(text, add_eos=True)
        got = np.frombuffer(table.encode([text])[0], np.int32)
        assert got.tolist() == want
        assert pieces.decode(got) == sp.decode(want)
    for ids in ([0], [1, 300, 2], [200, 201], [], [0, 5000]):
        assert pieces.decode(np.array(ids, np.int32)) == sp.decode(ids)
    assert table.encode([None]) == table.encode([""])


def test_ids_equal_the_library():
    known, want = packing.Ids(BYTES), Tokenizer.from_file(BYTES)
    assert known.ranks is not None
    for text in ODD:
        assert np.frombuffer(known.encode(text), "<u4").tolist() == [*want.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("limits", [(64, 8, 64), (64, 3, 40), (1024, 128, 1024)])
def test_packer_keeps_every_id_and_all_limits(limits):
    rng = random.Random(3)
    docs = {i: np.arange(rng.choice([1, 3, 30, 64, 65, 500]), dtype="<u4").tobytes() for i in range(400)}
    begin = {i: rng.randint(0, 40) for i in docs}
    packer = packing.Packer(limits, 50, 4, 7)
    for i, ids in docs.items():
        packer.add(i, ids, begin[i])
    packer.pack(0)
    pieces, sequences = {}, {}
    for doc, at, size, ids, total, sequence, offset, loss in packer.out:
        assert len(ids) == 4 * size and total == len(docs[doc]) // 4
        assert loss == sum(k >= begin[doc] for k in range(at, at + size))
        pieces.setdefault(doc, []).append((at, ids))
        sequences.setdefault(sequence, []).append((offset, size, loss))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == docs
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]
        assert sum(p[1] for p in parts) <= limits[0] and len(parts) <= limits[1] and sum(p[2] for p in parts) <= limits[2]


def test_little_padding():
    rng = random.Random(5)
    packer = packing.Packer((1024, 128, 1024), 256, 16, 0)
    total = 0
    for i in range(3000):
        n = int(rng.lognormvariate(6, 1))
        total += n
        packer.add(i, bytes(4 * n), 0)
    packer.pack(0)
    assert total / (1024 * len({p[5] for p in packer.out})) > 0.99


def _base(text):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_secrets_against_regex():
    scanner, kinds, rng = secrets.build(), {r.kind for r in secrets.BASE}, random.Random(1)
    parts = ["token", "TOKEN=", "secret = ", "api_key:'", "apikey", "password", "=", ":", " ", "'", "abcdef0123456789", "AKIA",
             "ABCDEFGH12345678", "é", "token : abcdefghijklmnop", "/", "x", "xoxb-", "9" * 17, "ghp_" + "a1B2" * 10]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in secrets.spans(scanner, text) if s[2] in kinds] == _base(text)
    assert secrets.spans(scanner, None) == []
    assert ("ghp_" + "a1B2" * 10) == "ghp_" + "a1B2" * 10 and secrets.spans(scanner, "é ghp_" + "Z1y2" * 9)[0] == (2, 42, "github")


def test_automaton_matches_re():
    rng = random.Random(2)
    patterns = ["a(b|c)*d", "[^a]b+", "(ab){2}c?", "a{1,}b", "x|yz"]
    trees = [automaton.parse(p) for p in patterns]
    for k, tree in enumerate(trees):
        found = automaton.compile_rules([tree], False)
        for _ in range(500):
            text = "".join(rng.choice("abcdxyz") for _ in range(rng.randint(0, 8)))
            state = found.start
            for byte in text.encode():
                state = found.rows[state][byte]
            assert bool(found.ends[state]) == bool(re.fullmatch(patterns[k], text))


def _naive_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_quality_counts():
    rng = random.Random(4)
    for text in [None, "", "\n \n", "a " * 40, "a\na\n a\n\nb", *(" ".join(rng.choice("abc") for _ in range(60)) for _ in range(60))]:
        assert quality.counts(text)[:5] == _naive_counts(text)


def test_trigram_bundles():
    trigrams = languages.Trigrams(64)
    got = languages.bundles([None, "", "12 !", "Ab, c", "ab c"], trigrams)
    assert not got[:3].any() and (got[3] == got[4]).all()
    word, want = " ab c ", np.zeros(64)
    for i in range(4):
        a, b, c = (trigrams.letter(ord(x)) for x in word[i:i + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert (got[3] == want).all()


def test_minhash_parts():
    assert len(near.shingles(None)) == len(near.shingles(" \n")) == 0
    assert len(near.shingles("one two")) == 1 and len(near.shingles("A b c d e f")) == 2
    assert (near.shingles("A B c d e") == near.shingles("a b C d E")).all()
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 4000, np.uint64)
    for share in (0.75, 0.95):
        keep = int(2 * 2000 * share / (1 + share))
        a, b = base[:2000], np.concatenate([base[:keep], base[2000:4000 - keep]])
        (x, n), (y, m) = near.odd_sketch(a), near.odd_sketch(b)
        odd = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        agree = (n + m + near.BITS / 2 * np.log(1 - 2 * odd / near.BITS)) / 2
        assert abs(agree / (n + m - agree) - share) < 0.06


def test_cover_tree_links_are_exact():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    points = np.concatenate([c + s * rng.normal(size=(60, 16)) for c, s in zip(centre, np.linspace(0.001, 0.6, 12))])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    n = rng.integers(1, 4, len(points))
    linked = points @ points.T >= 0.9
    np.fill_diagonal(linked, False)
    one, _, root = cover.traverse(points, points, n, n, 0.9, True, leaf=16)
    assert (one == linked @ n).all()
    label = np.arange(len(points))
    for _ in range(200):
        label = np.minimum(label, np.where(linked, label[None, :], len(points)).min(axis=1))
    assert (root == label).all()
    half = len(points) // 2
    a, b, _ = cover.traverse(points[:half], points[half:], n[:half], n[half:], 0.9, False, leaf=16)
    assert (a == linked[:half, half:] @ n[half:]).all() and (b == n[:half] @ linked[:half, half:]).all()


def test_tight_groups_do_not_count_themselves():
    rng = np.random.default_rng(5)
    tight = [np.eye(16)[0], np.eye(16)[0] + 0.2 * np.eye(16)[1]]
    points = np.concatenate([c + 0.003 * rng.normal(size=(200, 16)) for c in tight])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    n = rng.integers(1, 4, len(points))
    for cosine in (0.9, 0.99, 0.9998):
        linked = points @ points.T >= cosine
        np.fill_diagonal(linked, False)
        assert (cover.traverse(points, points, n, n, cosine, True)[0] == linked @ n).all()


@pytest.mark.parametrize("width", [8, 40, 64])
def test_leading_columns_bound_the_cosine(width):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(1500, width))
    points = np.concatenate([points, points[:200] + 0.05 * rng.normal(size=(200, width)), points[:100] * 3])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    a, b, less = cover._leading(points, points[::2])
    cosine, bound = points @ points[::2].T, a.astype(float) @ b.astype(float).T
    assert (a @ b.T >= cosine - less).all() and (bound >= cosine - less).all()
    # Hardly any pair of vectors without neighbours is left to be compared in full.
    assert a.shape[1] < width or width < 32
    assert ((a @ b.T >= 0.9 - less) & (cosine < 0.85)).mean() < 0.003


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Menu one</a></ul></nav><div class="cookie-notice">We use cookies on this site to do things for you.</div>
<div id="wrap">%s</div><aside>Side text that is rather long but no part of the article.</aside>
<section id="comments"><article class="comment"><p>A reader says a lot of things here, and more of them.</p></article></section>
<form><label>Name</label><input></form><footer>&copy; all</footer></body></html>"""
BODY = "<h1>Title &amp; more</h1><p>First   <b>long</b>\nparagraph of the text with enough words.<p>Short.<br>line<script>x</script><div class='ad'>Buy</div><p>Last paragraph of the text, it has words."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div class='content'>%s</div>", "<main>%s</main>"])
def test_pages(wrap):
    assert pages.main_text(PAGE % (wrap % BODY)) == (
        "Title & more\nFirst long paragraph of the text with enough words.\nShort. line\nLast paragraph of the text, it has words.")
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<nav>x</nav>") == ""


def test_chat_round_trip():
    known = chat.tokenizer(BYTES)
    rng = random.Random(6)
    parts = ["<|im_end|>", "<|im_start|>assistant ok", "<", "|", "\\", "<\\|", "<\\\\|im_sep|>", " ", "\n", "a", "é😀", "!", "<|endoftext|>", "word "]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "sys<|tem"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))))
                 for _ in range(rng.randint(1, 6))]
        text, spans = chat.render(*zip(*turns))
        assert [(chat.unescape(r), chat.unescape(t)) for r, t in chat.TURN.findall(text)] == turns
        offsets = np.array(known.encode(text, add_special_tokens=False).offsets).reshape(-1, 2)
        flags = chat.mask(spans, offsets[:, 0], offsets[:, 1])
        loss = "".join(chat.unescape(text[a:b]) for a, b in chat.covered(offsets[:, 0], offsets[:, 1], flags))
        assert loss == "".join(t for r, t in turns if r == "assistant")


def test_lookup_table():
    table = sharding.lookup_table({"a": 1, "b": 2, "c": 1}, 101)
    assert sorted(set(table)) == [0, 1, 2] and abs(table.count(1) - 50) <= 2
    before, after = sharding.lookup_table([f"s{i}" for i in range(10)], 2003), sharding.lookup_table([f"s{i}" for i in range(9)], 2003)
    moved = sum(x != y for x, y in zip(before, after) if x != 9)
    assert moved < 0.2 * 2003
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_pages_without_an_article_stay_whole():
    long, short, lead = "word " * 160, "less " * 20, "lead " * 20
    cases = {
        f"<body><div><h1>T</h1><p>{long}</p><p>{short}</p></div></body>": ["T", long, short],
        f"<body><div><h1>T</h1><div><p>{long}</p></div><p>{short}</p></div></body>": ["T", long, short],
        f"<body><div><h1>T</h1><p>{lead}</p><div><p>{long}</p><p>{long}</p></div><div><h2>S</h2><p>{short}</p></div></div></body>":
            ["T", lead, long, long, "S", short],
        f"<body><nav>menu</nav><article><p>{long}</p></article><article><p>ok</p></article>"
        f"<article class=comment><p>{short}</p></article></body>": [long, "ok"],
        f"<body><nav><a href=/>menu</a></nav><div><h1>T</h1><p>{long}</p></div><footer>{short}</footer></body>": ["T", long],
    }
    for html, lines in cases.items():
        assert pages.main_text(html) == "\n".join(x.strip() for x in lines)


def test_secret_offsets_of_a_long_text_in_code_points():
    import time
    text = "é日😀 token = abcdefghijklmnop0123\n" * 20_000
    start = time.perf_counter()
    found = secrets.spans(secrets.build(secrets.RULES), text)
    assert time.perf_counter() - start < 30
    base = [s for s in found if s[2] == "assign"]
    assert len(base) == 20_000 and all(text[a:b].startswith("token = abc") and b - a == 28 for a, b, _ in base[::999])
