import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import byte_bpe, range_coder, token_binary, token_counts
from textloom.llm.arrow_text import flat
from tests.llm.conftest import docs_frame, words


@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 5), st.integers(0, range_coder.MOST_ID)), max_size=300), max_size=12))
@settings(max_examples=25, deadline=None)
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.int64) for b in blocks]
    back = range_coder.decode(range_coder.encode(blocks), [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(back, blocks, strict=True))


def test_ids_and_blocks_beyond_what_can_be_coded_are_errors():
    with pytest.raises(ValueError, match="id"):
        range_coder.encode([np.array([range_coder.MOST_ID + 1])])
    with pytest.raises(ValueError, match="block"):
        range_coder.encode([np.zeros(range_coder.TOKENS + 1, np.int64)])


def test_coded_size_on_the_given_texts():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"]
    ids, _ = byte_bpe.token_ids(*flat(texts))
    blocks = [ids[i : i + range_coder.TOKENS] for i in range(0, len(ids), range_coder.TOKENS)]
    coded = range_coder.encode(blocks)
    assert sum(map(len, coded)) * 8 / len(ids) < 8.0
    assert all((a == b).all() for a, b in zip(range_coder.decode(coded[::20], [len(b) for b in blocks[::20]]), blocks[::20], strict=True))


def test_coder_learns():
    text = np.tile(np.arange(300, 350), 80).astype(np.uint16)
    assert len(range_coder.encode([text])[0]) < len(text) / 3


@given(st.lists(st.text(st.sampled_from("ab 'sé\n\t 　.,1日—\x1c"), max_size=40), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_ids_are_those_of_whole_texts(texts):
    ids, n = byte_bpe.token_ids(*flat(pa.array(texts)))
    own = [byte_bpe.encoding().encode_ordinary(t) for t in texts]
    assert n.tolist() == [len(x) for x in own] and ids.tolist() == [i for x in own for i in x]


def test_documents_round_trip(spark, odd):
    rng = random.Random(6)
    docs = docs_frame(spark, [(100 + i, words(rng, rng.choice([0, 1, 50, 900])), "s") for i in range(60)]).unionByName(odd.filter("doc_id <> 4")).repartition(3)
    blocks = token_binary.write_blocks(docs, block=256)
    assert blocks.agg({"ids": "max"}).first()[0] <= 256
    parts: dict = {}
    for r in token_binary.read_blocks(blocks).collect():
        parts.setdefault(r.doc_id, []).append((r.first_token, r.ids))
    found = {k: [x for _, ids in sorted(v) for x in ids] for k, v in parts.items()}
    assert found == {r.doc_id: byte_bpe.encoding().encode_ordinary(r.text or "") for r in docs.filter("doc_id is not null").collect()}


def test_a_wrong_checksum_is_an_error(spark):
    blocks = token_binary.write_blocks(docs_frame(spark, [(1, "some words to write", "s")]))
    with pytest.raises(Exception, match="checksum"):
        token_binary.read_blocks(blocks.withColumn("crc32", blocks.crc32 + 1)).collect()


def test_no_documents(none):
    assert token_binary.write_blocks(none).count() == token_counts.count_tokens(none).count() == 0


def brute(word: str, pieces: dict[str, float], unknown: float, byte_pieces: bool) -> tuple[float, int]:
    """All segmentations: the best score, and of equal ones the longer last piece, from the end backwards."""
    best = {0: (0.0, 0, False)}
    for end in range(1, len(word) + 1):
        options = [(best[a][0] + pieces[word[a:end]], end - a, best[a][1] + 1, False) for a in range(end) if word[a:end] in pieces]
        if word[end - 1] not in pieces:
            score, count, was = best[end - 1]
            options.append((score + unknown, 0, count + (len(word[end - 1].encode()) if byte_pieces else not was), True))
        score, _, count, is_unknown = max(options, key=lambda o: (o[0], o[1]))
        best[end] = (score, count, is_unknown)
    return best[len(word)][:2]


@given(st.lists(st.one_of(st.text(st.sampled_from("abcé鱻"), max_size=12), st.text(st.sampled_from("abcd"), min_size=60, max_size=200)), min_size=1, max_size=5), st.booleans())
@settings(max_examples=80, deadline=None)
def test_viterbi_against_brute_force(texts, byte_pieces):
    pieces = {"a": -2.0, "b": -2.0, "ab": -4.0, "ba": -3.0, "aba": -3.5, "abab": -8.0, "c": -1.0, "cab": -5.0}
    own = token_counts.Segmenter(list(pieces.items()), byte_pieces)
    score, n = own.best(texts)
    assert list(zip(score, n, strict=True)) == [brute(t, pieces, own.unknown, byte_pieces) for t in texts]


def test_white_space_and_bytes_count_as_the_model_counts_them():
    """Where neither merges nor scores matter, the counts are those of sentencepiece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.TOKENIZER)
    texts = ["", " ", "   ", "\n", "a\n\nb", "a  b", " a", "a ", "\t", "鱻鱻", "a\u3000b", "▁ a", "a▁b", "a b\tc", "€ ☃ \U0001f600\U0001faa8"]
    data, starts, ends, row = token_counts.parts(*flat(pa.array(texts)))
    found = token_counts.Segmenter(*token_counts.vocabulary()).best([data.tobytes()[a:b].decode().replace(" ", token_counts.MARK) for a, b in zip(starts, ends, strict=True)])[1]
    assert np.bincount(row, found, minlength=len(texts)).tolist() == [len(model.encode(t)) for t in texts]


def test_counts_of_documents(spark, odd):
    """Whole texts by brute force, uncut."""
    listed, byte_pieces = token_counts.vocabulary()
    pieces, unknown = dict(listed), token_counts.Segmenter(listed).unknown
    long = [r.doc_id for r in odd.filter("length(text) > 10000").collect()]
    for r in token_counts.count_tokens(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        if r.doc_id not in long:
            score, n = brute((" " + r.text if r.text else "").replace(" ", token_counts.MARK), pieces, unknown, byte_pieces)
            assert r.n_tokens == n and abs(r.score - score) < 1e-6 * max(1, abs(r.score))
    assert token_counts.count_tokens(odd).filter("doc_id in (1, 2)").agg({"n_tokens": "sum"}).first()[0] == 0
    assert token_counts.count_tokens(odd).count() == odd.count()


def test_cache_gives_the_same_when_it_empties():
    from textloom.llm.spans_cache import SpanCache

    own = SpanCache(lambda spans: (np.array([len(x) for x in spans for _ in range(2)]), np.full(len(spans), 2, np.int64)), np.int64, limit=50)
    for k in range(6):
        texts = [f"w{i}" * (i % 7 + 1) for i in range(k * 40, k * 40 + 120)] * 2
        data, offs = flat(pa.array(texts))
        assert own.look_up(data, offs[:-1], offs[1:])[0].tolist() == [len(t) for t in texts for _ in range(2)]
