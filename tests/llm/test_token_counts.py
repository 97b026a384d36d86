import math
import random

import public_tokenizers
import regex

from innsight.llm.token_counts import LONG, PretokenTrie, token_counts, zipf_scores

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def viterbi(raw: bytes, scores) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(raw) + 1):
        found = [(best[s][0] + scores[raw[s:end]], best[s][1] + 1) for s in range(end) if raw[s:end] in scores]
        best.append(min(found, key=lambda x: (-x[0], x[1])))
    return best[-1][1]


def test_trie_equals_viterbi_without_sharing():
    scores = zipf_scores(RANKS)
    rng = random.Random(1)
    words = {"".join(rng.choice("thernandé ß1") for _ in range(rng.randrange(1, 40))) for _ in range(400)} | {"", "a", "the", " the"}
    trie = PretokenTrie(scores)
    trie.add(set(list(words)[:150]))
    trie.add(words)
    assert {w: trie.known[w] for w in words} == {w: viterbi(w.encode(), scores) for w in words}


def test_ties_take_fewer_pieces_and_long_words_agree():
    scores = {b"a": -1.0, b"b": -1.0, b"ab": -2.0, b"c": -1.0}
    trie = PretokenTrie(scores)
    trie.add({"ab", "abc", "aab"})
    assert trie.known == {"ab": 1, "abc": 2, "aab": 2}
    long = "ab" * LONG
    trie.add({long})
    assert trie.known[long] == LONG == viterbi(long[:2].encode(), scores) * LONG


def test_forgetting_does_not_change_counts():
    scores = zipf_scores(RANKS)
    small = PretokenTrie(scores, max_known=3)
    for some in ({"hello", "help"}, {"helping", "held"}, {"hello", "xyz"}):
        small.add(some)
        assert all(small.known[w] == viterbi(w.encode(), scores) for w in some)


def test_scores_are_probabilities():
    assert math.isclose(sum(math.exp(s) for s in zipf_scores(RANKS).values()), 1.0)


def test_counts_of_odd_documents(spark, docs_of, odd_docs):
    scores, split = zipf_scores(RANKS), regex.compile(public_tokenizers.PATTERN).findall
    got = sorted(map(tuple, token_counts(docs_of(odd_docs).selectExpr("doc_id", "text", "1 AS n_tokens"), RANKS).collect()), key=str)
    trie = PretokenTrie(scores)
    for _, t in odd_docs:
        trie.add(set(split(t or "")))
    want = sorted(((i, len(split(t or "")), sum(trie.known[w] for w in split(t or ""))) for i, t in odd_docs), key=str)
    assert got == want
    assert token_counts(docs_of([]), RANKS).collect() == []
