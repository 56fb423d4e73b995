"""Words that polynomial hashes cannot tell apart, and white space in odd places."""

import random
from collections import Counter

import numpy as np
import pytest
import text_brute as brute

from lotwise.llm import debruijn, jaccard, rolling, tokens
from lotwise.staging import Staging


def thue_morse(n, low="a", high="b"):
    return "".join(high if bin(i).count("1") % 2 else low for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_few_letters(spark, n):
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    filler = [f"w{i}" for i in range(60)]
    texts = [one, other, f"{one} {other}", " ".join([one] * 40), " ".join([other] * 40)]
    texts += [" ".join([*filler[:20], word, *filler[20:]]) for word in (one, other)]
    texts += [" ".join(word for _ in range(4) for word in (a, b)) for a, b in ((one, other), (other, one))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same = lambda df, expected: Counter(map(tuple, df.collect())) == Counter(expected)
    assert same(jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id"), brute.jaccard(rows))
    assert same(debruijn.remove_repeated_words(docs), brute.repeated_words(rows))
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.TOKENIZER)
    folder = Staging(spark).new_path("tokens")
    tokens.write_token_files(docs, path, folder)
    assert same(tokens.read_token_files(spark, folder), brute.encoded(rows, Tokenizer.from_file(path)))


def test_word_hashes():
    draw = random.Random(1)
    words = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 200))) for _ in range(3000)}
    words |= {thue_morse(2**k, a, b) for k in range(13) for a, b in ("ab", "ba")} | {"a" * k for k in range(1, 300)}
    words = sorted(words)
    data = np.frombuffer("  ".join(words).encode(), np.uint8)
    starts, ends, _ = rolling.word_spans(data, np.array([0, len(data)]), rolling.NOT_SPACE)
    once, second = (rolling.word_hashes(data, starts, ends, t) for t in (0, 1))
    assert len(starts) == len(words) == len(set(once.tolist())) == len(set(second.tolist()))
    assert not set(once.tolist()) & set(second.tolist())
    alone = [rolling.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words[::50]]
    assert alone == once[::50].tolist()


def test_blanks_inside_white_space():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.TOKENIZER)
    own, library, draw = tokens.Encoder(path), Tokenizer.from_file(path), random.Random(6)
    signs = [" ", " ", " ", "\n", "\t", " ", "　", "\x0b", "\x1c", "a", "B", ".", "é", "'s", "7", "<|endoftext|>", "\0", "a,", ":", "?"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 12))) for _ in range(6000)]
    raw = [t.encode() for t in texts]
    ids, n = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    found = [f.tolist() for f in np.split(ids, np.cumsum(n)[:-1])]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
