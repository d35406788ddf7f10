import numpy as np
import pytest

from arcwright import tables
from arcwright.llm import common as C


def hashed(words, lane=0):
    ends = np.cumsum([len(w) for w in words])
    return C.range_hashes(np.frombuffer(b"".join(words), np.uint8), ends - np.array([len(w) for w in words]), ends, lane)


@pytest.mark.parametrize("n", [64, 512, 1024, 2048, 4096])
def test_thue_morse_words_differ(n):
    word = bytes(97 + i.bit_count() % 2 for i in range(n))
    other = bytes(97 + 98 - x for x in word)
    for lane in (0, 1):
        a, b, c = hashed([word, other, word], lane)
        assert a == c != b


def test_hashes_depend_on_bytes_and_length_alone():
    r = np.random.default_rng(0)
    words = [r.integers(0, 4, n).astype(np.uint8).tobytes() for n in [*range(40), *[511, 512, 513, 700] * 2] for _ in range(20)]
    h = [(int(a), int(b)) for a, b in zip(hashed(words), hashed(words, 1), strict=True)]
    assert len(set(h)) == len(set(words)) and len({a for a, _ in h}) == len(set(words))
    by = dict(zip(words, h, strict=True))
    assert all(by[w] == x for w, x in zip(words, h, strict=True))
    assert len(hashed([b"", b"\0", b"\0\0"])) == len(set(hashed([b"", b"\0", b"\0\0"]).tolist())) == 3


def test_tables_of_a_session_are_deleted(spark):
    df = C.stored(spark.range(5), "x")
    path = df._path.removeprefix("file://")
    assert df.count() == 5
    tables.discard(df)
    import os

    assert not os.path.exists(path)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Session())
