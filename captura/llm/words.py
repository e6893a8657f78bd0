"""Word hashes and shingles of texts as numpy arrays."""

import numpy as np

from captura.llm.common import worker_state

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


class HashTable(dict):
    """64-bit hash of each word, kept for the next texts; starts anew beyond ``limit`` words."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def hash_table() -> HashTable:
    state = worker_state()
    table = state.setdefault("hashes", HashTable())
    if len(table) > table.limit:
        table.clear()
    return table


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: bytes know no other letters or spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes], table: HashTable) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * STEP
    return h ^ (h >> np.uint64(29))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = out * MIX + hashes[k : k + count]
    return finish(out)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct ascending shingles of a document; the whole sequence where it has fewer than ``n`` words."""
    h = np.sort(window_hashes(hashes, min(n, len(hashes)) or 1))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
