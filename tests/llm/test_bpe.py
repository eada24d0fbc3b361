import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from tessella.llm import bpe
from tessella.llm.common import utf8


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Vocabulary(bpe.read_ranks(bpe.default_path())), bpe.character_classes())


def test_ids_equal_the_library_on_random_texts(codec, reference):
    rng = random.Random(1)
    signs = "aab 's t're'll  \n\t éñ北京12٣!'-\U00018de7\U000323e7 \x1c\x85　lL"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "'s", "a'ret 'there", " " * 3000, "ab" * 2000 + "x", "!" * 1500, "é" * 900]
    data, offsets = utf8(pa.array([*texts, None]))
    ids, at = codec.encode(data, offsets)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == reference.encode_ordinary(text), text[:60]
    assert codec.decode(ids).tobytes() == data.tobytes()


def test_long_pieces_by_heap_equal_matrix(codec):
    word = np.frombuffer(("abcab" * 100).encode(), np.uint8)
    short, _ = bpe.encode_pieces(word, np.array([0]), np.array([len(word)]), codec.vocabulary)
    assert bpe._merged_long(codec.vocabulary.byte_id[word].tolist(), codec.vocabulary) == short.tolist()


def test_digests_of_odd_documents(odd, empty, reference):
    rows = bpe.encode_documents(odd, keep=("ids", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == odd.count()
    texts = {(r.doc_id): r.text or "" for r in odd.collect()}
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode_documents(empty).count() == 0
