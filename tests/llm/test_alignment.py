import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import alignment as A


def byte_alphabet():
    """The byte-level decoder's characters, as the JSON vocabulary writes them."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            out[chr(256 + n)] = b
            n += 1
    return out


def brute(rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    back, parsed, count = byte_alphabet(), [], Counter()
    for key, text in rows:
        whole = (" " + (text or "")).encode()
        links, groups, a, b = [], [], [], []
        if text:
            a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(whole.decode(), add_special_tokens=False).ids]
            for i in sp.encode(text):
                p = sp.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and sp.is_byte(i)
                          else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        i = j = pa = pb = 0
        ga, gb = [], []
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            ea, eb = pa + len(a[i][1]), pb + len(b[j][1])
            if ea <= eb:
                ga.append(str(a[i][0]))
                i, pa = i + 1, ea
            if eb <= ea:
                gb.append(str(b[j][0]))
                j, pb = j + 1, eb
            if ea == eb:
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        count.update(links)
        parsed.append((key, len(a), len(b), groups, links))
    best = {}
    for (x, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(key, na, nb, len(groups), len(links), sum(count[x] == best[x[1]] for x in links),
             sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for key, na, nb, groups, links in parsed]


def fixture():
    rng = random.Random(2)
    bits = ["The quick", "brown  fox", "naïve café", "<|endoftext|>", "<s> </s>", "😀😀", "tabs\tand\nlines", "12345,",
            "ünïcödé", "don't", "x" * 30, "日本語", " ", "\x01", "antidisestablishmentarianism"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randrange(1, 40)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "plain words " * 900), (104, "plain words " * 900),
             (None, "the end"), (None, None), (105, "z" * 3000), (106, "ab" * 700 + " the words go on " * 60),
             (107, "-" * 5000), (108, "a b " + "　" * 50)]
    return rows


def order(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


@pytest.mark.parametrize("size, fan, frequent", [(1 << 16, 16, 1 << 20), (64, 2, 50), (300, 3, 1)])
def test_alignment_equals_brute_force(spark, size, fan, frequent):
    rows = fixture()
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], "doc_id long, text string, row int, code string, n_a int")
    got = A.align(df.repartition(5), size=size, fan=fan, frequent=frequent).collect()
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(brute(rows), key=order), strict=True):
        assert g == w
    assert A.align(df.limit(0), size=size).count() == 0
    none = A.align(df.where("text is null"), size=size).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_composition_is_associative_at_any_byte():
    tok = A.Tokenizers()
    rng = random.Random(4)
    for _, text in fixture()[:25]:
        data = b" " + (text or "x").encode()
        tokens = tok.encode(data)
        whole = A.fragment(tokens, 0, 0, len(data))
        for _ in range(8):
            cut = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(6))})
            parts = [A.fragment(tokens, 0, s, e) for s, e in zip(cut, cut[1:], strict=False)]
            while len(parts) > 1:  # in any order of brackets
                i = rng.randrange(len(parts) - 1)
                parts[i:i + 2] = [A.compose(parts[i], parts[i + 1])]
            f = parts[0]
            assert (f.n_a, f.n_b, f.n_groups, f.groups) == (whole.n_a, whole.n_b, whole.n_groups, whole.groups)
            assert (f.codes == whole.codes).all() and (f.times == whole.times).all()
            assert not len(f.pre[0]) and not len(f.suf[0])


def test_pack_round_trip():
    codes = np.sort(np.random.default_rng(0).integers(0, 1 << 31, 5000))
    for c in (codes, codes[:0], codes[:1]):
        got = A._unpack(A._pack(c, np.arange(len(c))))
        assert (got[0] == c).all() and (got[1] == np.arange(len(c))).all()


def test_rank_table_is_the_vocabulary():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    t, back = Tokenizer.from_file(P.path("byte_bpe_50k.json")), byte_alphabet()
    assert all(bytes(back[c] for c in t.id_to_token(i)) == x for i, x in ranks.items())
