"""Cross-tokenizer alignment against a plain walk over both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm_data import CLASHING, EDGE, documents, prose
from vitrine.llm import alignment, tokens


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))


def texts(seed):
    r = random.Random(seed)
    out = [t for _, t, _, _ in EDGE]
    words = "the house of Straße, don't naïve 12,345 running unbelievable (see) été ... I'm x2 <|endoftext|> </s>".split()
    for _ in range(120):
        out.append("".join(r.choice((" ", " ", " ", "  ", "\n", " \n ", "\n  ", "\t", "", "\n\n", "   ")) + r.choice((w, r.choice(words)))
                           for w in prose(r, r.randint(0, 60))) + r.choice(("", " ", "\n", "  ")))
    return out + [" ", "\n", "  x", "a", "<|endoftext|>", "<s> a </s>", "a▁b", "▁", "\xa0x　y", "\U0001f600" * 9,
                  "é ﬁ ½", "\r\n a", "<0x41> <unk>", "\x00a", "word " * 9000, "aaaa" * 3000]


def brute(libraries, rows):
    a_lib, b_lib = libraries
    letters = tokens.byte_letters()
    docs, counts = [], Counter()
    for doc_id, text, *_ in rows:
        a = b = ()
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        xs = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        ys = [alignment.piece_bytes(b_lib.id_to_piece(i)) for i in b]
        if not text or b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        links, groups, i, j, p, q = [], [[[], []]], 0, 0, 0, 0  # p, q: ends of the tokens i, j
        p, q = len(xs[0]), len(ys[0])
        groups[-1][0].append(a[0]), groups[-1][1].append(b[0])
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = p <= q, q <= p
            if step_a and step_b and i + 1 == len(a):
                break
            if step_a and step_b:
                groups.append([[], []])
            if step_a:
                i += 1
                p += len(xs[i])
                groups[-1][0].append(a[i])
            if step_b:
                j += 1
                q += len(ys[j])
                groups[-1][1].append(b[j])
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links),
                    sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if links else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [alignment.BLOCK, 500])
def test_against_both_libraries(spark, libraries, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "AT_ONCE", block // 3)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(4))] + [(None, "a b c", "en", "s"), (3, "the the", "en", "s")]
    want = brute(libraries, rows)
    assert sum(w[4] > w[3] > 0 for w in want) > 50
    assert sorted((tuple(r) for r in alignment.align(documents(spark, rows, **CLASHING)).collect()), key=str) == want


def test_without_the_proof_the_library_reads_all(spark, libraries, monkeypatch):
    monkeypatch.setattr(tokens, "merges_alike", lambda file: False)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(5)[:60])]
    assert sorted((tuple(r) for r in alignment.align(documents(spark, rows)).collect()), key=str) == brute(libraries, rows)


def test_identity_map(libraries):
    with open(public_tokenizers.path(alignment.A_FILE)) as f, open(public_tokenizers.path(alignment.B_FILE), "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read(), True)
    for i, j in enumerate(aligner.same.tolist()):
        assert j < 0 or aligner.a_bytes[i] == aligner.b_bytes[j]
    assert (aligner.same >= 0).sum() > 10_000


def test_no_rows_and_no_tokens(spark, libraries):
    docs = documents(spark, EDGE[:2])
    assert alignment.align(docs.limit(0)).count() == 0
    assert sorted(tuple(r) for r in alignment.align(docs).collect()) == brute(libraries, EDGE[:2])
