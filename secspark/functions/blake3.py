"""BLAKE3 after its public specification, vectorised over messages of equal shape."""

from __future__ import annotations

import numpy as np

#: Initial state words, and the order of message words from round to round.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64


def _mix(v, a: int, b: int, c: int, d: int, x, y) -> None:
    turn = lambda w, n: (w >> np.uint32(n)) | (w << np.uint32(32 - n))
    for add, first, second in ((x, 16, 12), (y, 8, 7)):
        v[a] = v[a] + v[b] + add
        v[d] = turn(v[d] ^ v[a], first)
        v[c] = v[c] + v[d]
        v[b] = turn(v[b] ^ v[c], second)


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8, n) of ``cv (8, n)`` and message words (16, n); counter, length and flags of each."""
    n = cv.shape[1]
    low, high = (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32)
    v = [*cv.copy(), *(np.full(n, x, np.uint32) for x in IV[:4]), low, high, length.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)
    for _ in range(7):
        for k in range(4):
            _mix(v, k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            _mix(v, k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        m = [m[p] for p in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def _start(n: int) -> np.ndarray:
    return np.repeat(np.array(IV, np.uint32)[:, None], n, axis=1)


def _chunks(messages: list[bytes], of: np.ndarray, counter: np.ndarray, size: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of chunks ``counter`` of messages ``of``; ``alone``: the message has no other."""
    data = np.zeros((len(of), CHUNK), np.uint8)
    for i, (m, c, n) in enumerate(zip(of.tolist(), counter.tolist(), size.tolist(), strict=True)):
        data[i, :n] = np.frombuffer(messages[m], np.uint8, n, c * CHUNK) if n else 0
    blocks = np.maximum(1, -(-size // BLOCK))
    cv = _start(len(of))
    for k in range(int(blocks.max())):
        live = np.flatnonzero(blocks > k)
        last = blocks[live] == k + 1
        words = np.ascontiguousarray(data[live, k * BLOCK : (k + 1) * BLOCK]).view("<u4").T
        flags = CHUNK_START * (k == 0) | np.where(last, CHUNK_END | np.where(alone[live], ROOT, 0), 0)
        cv[:, live] = _compress(cv[:, live], words, counter[live], np.minimum(BLOCK, size[live] - k * BLOCK), flags)
    return cv


#: Chunks that are hashed at once.
LANES = 4096


def blake3(messages: list[bytes]) -> list[bytes]:
    """32-byte digests."""
    if not messages:
        return []
    length = np.array([len(m) for m in messages], np.int64)
    count = np.maximum(1, -(-length // CHUNK))
    of = np.repeat(np.arange(len(messages)), count)
    counter = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(CHUNK, length[of] - counter * CHUNK)
    cv = np.concatenate([_chunks(messages, of[x : x + LANES], counter[x : x + LANES], size[x : x + LANES], count[of[x : x + LANES]] == 1) for x in range(0, len(of), LANES)], axis=1)
    # neighbours are joined level by level; a last one without a neighbour goes up as it is
    while len(of) > len(messages):
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[of]))
        n = len(left)
        root = np.where(count[of[left]] == 2, PARENT | ROOT, PARENT)
        cv[:, left] = _compress(_start(n), np.concatenate((cv[:, left], cv[:, left + 1])), np.zeros(n, np.int64), np.full(n, BLOCK), root)
        stay = np.flatnonzero(place % 2 == 0)
        cv, of, count = cv[:, stay], of[stay], -(-count // 2)
    out = np.ascontiguousarray(cv.T).astype("<u4").view(np.uint8).reshape(len(messages), 32)
    return [d.tobytes() for d in out]
