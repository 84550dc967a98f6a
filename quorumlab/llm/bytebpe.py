"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The ids of a byte string are the one sequence of tokens in which every neighbouring pair is
stable, that is, no merge across their border comes before the merges that build the two.  So
reading left to right, each prefix has one last token, found among its suffixes by that test.
A border is settled once the sequences of all prefixes that a longer token could still start
from run through it; tokens up to it are emitted.  What is left depends only on the last settled
token and the bytes read since: that pair is the transducer's state.  A transition is made when it
is asked for the second time; the first time, the rest of a short pre-token is read by following all
open tokens side by side, as most rare ones never come again.  Transitions and the ids of finished
pre-tokens are kept up to a bound, in two generations: what was not used during one of them goes.

Decoding feeds token bytes to an incremental UTF-8 machine which holds back a character that is
not complete yet, so a stream can be decoded in chunks cut anywhere between ids.

Null and empty texts have no ids; texts of any length are encoded whole.  Repeated rows are encoded each, null keys stay null, other
columns are ignored, an empty table gives no rows.  One pass over the texts, no shuffle.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
import unicodedata
from array import array
from bisect import insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from quorumlab.llm import frames
from quorumlab.llm.memo import Recent, loaded, working_for

#: Transitions, stability tests and pre-tokens of a generation; a worker keeps two.
MAX_STEPS, MAX_PAIRS, MEMO_PIECES = 200_000, 250_000, 400_000
#: Places (a power of two) that mark which transitions were asked for; two that share one are made early.
ASKED = 1 << 20
#: Bytes that may be left of a pre-token which is read without making transitions.
REST = 64
#: Characters that are split into pre-tokens at a time, about.
CHUNK = 1 << 20
#: Ids that are decoded at a time.
STREAM_IDS = 8192
NEVER = 1 << 40
#: Beyond these, characters may be of another class in a newer Unicode; those that Python does
#: not know yet go to the library, which has its own tables.
NEW = re.compile("[^\x00-\u0377]")
#: A blank between two other characters: no pre-token runs from the one before into it.
SAFE = re.compile(r"(?<=\S) (?=\S)")


class Utf8Stream:
    """Incremental UTF-8: gives all complete characters, holds back the start of one."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                needed = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
                if needed > back:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        text, self.held = self.held.decode("utf-8", "replace"), b""
        return text


class ByteBpe:
    """Encoder and decoder for a rank file; one instance per worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.decimal = [str(i) for i in range(self.size)]
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node, over all tokens; node 0 is the root
        self.ending, self.inner = array("l", [-1]), bytearray([1])  # a node's token or -1; whether longer ones go on
        for piece, rank in ranks.items():
            node = 0
            for byte in piece:
                self.inner[node] = 1
                following = self.trie.get(node << 8 | byte)
                if following is None:
                    following = self.trie[node << 8 | byte] = len(self.inner)
                    self.ending.append(-1)
                    self.inner.append(0)
                node = following
            self.ending[node] = rank
        # The first two bytes of a token come by place, not by look-up: most open tokens end there.
        self.one = [self.trie.get(byte, -1) for byte in range(256)]
        self.first = {node: byte for byte, node in enumerate(self.one) if node >= 0}
        self.two = array("l", [-1]) * 65536
        for key, node in self.trie.items():
            if (first := self.first.get(key >> 8)) is not None:
                self.two[first << 8 | key & 255] = node
        self.find = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self.pairs: dict[int, bool] = {}  # left token << 32 | right token
        self.old_pairs: dict[int, bool] = {}
        self.pieces = Recent(self._piece, MEMO_PIECES)
        self._library: tiktoken.Encoding | None = None
        self.pattern = pattern
        self._start()

    # The stability test.

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for a byte, (-1, -1) if merges never build it."""
        if token not in self.halves:
            parts = [self.token[token][i : i + 1] for i in range(len(self.token[token]))]
            if len(parts) == 1:
                self.halves[token] = None
            else:
                while len(parts) > 2:
                    best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                    if best >= token:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                built = len(parts) == 2 and all(part in self.ranks and self.ranks[part] < token for part in parts)
                self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if built else (-1, -1)
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        return self.split(token) != (-1, -1)

    def spine(self, token: int, side: int) -> list[int]:
        """The tokens along one edge as ``token`` is built: from its outer byte to itself."""
        known = self.spines[side]
        if token not in known:
            path, at = [token], self.split(token)
            while at is not None:
                path.append(at[side])
                at = self.split(at[side])
            known[token] = path[::-1]
        return known[token]

    def stable(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' joined bytes end in these two tokens.

        ``left`` is -1 at the start of a pre-token.
        """
        known = self.old_pairs.get(left << 32 | right)
        if known is None:
            known = self._meet(left, right)
        if len(self.pairs) >= MAX_PAIRS:
            self.old_pairs, self.pairs = self.pairs, {}
        self.pairs[left << 32 | right] = known
        return known

    def _meet(self, left: int, right: int) -> bool:
        if not self.reachable(right):
            return False
        if left < 0:
            return True
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            across = self.ranks.get(self.token[a[i]] + self.token[b[j]], NEVER)
            grows_left = a[i + 1] if i + 1 < len(a) else NEVER
            grows_right = b[j + 1] if j + 1 < len(b) else NEVER
            if across < grows_left and across <= grows_right:
                return False
            if grows_left == grows_right == NEVER:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    # The transducer.  A state has, for the settled border and each place after it, the last
    # token of the ids up to there (-2 where no later token can start or pass), and the node of
    # the bytes since in the trie of tokens (-1 where no token goes on).

    def _start(self) -> None:
        self.numbers: dict[tuple[int, bytes], int] = {}
        self.states: dict[int, tuple[tuple[int, ...], tuple[int, ...], bytes]] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.old_steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.made, self.asked = 0, bytearray(ASKED)
        self._number((-1,), (0,), b"")

    def _age(self) -> None:
        """Transitions not taken during the last generation go, and the states that only they know."""
        self.old_steps, self.steps = self.steps, {}
        known = {0, *(key >> 8 for key in self.old_steps), *(to for to, _ in self.old_steps.values())}
        self.states = {number: state for number, state in self.states.items() if number in known}
        self.numbers = {(tokens[0], pending): number for number, (tokens, _, pending) in self.states.items()}
        self.asked = bytearray(ASKED)

    def _number(self, tokens: tuple[int, ...], nodes: tuple[int, ...], pending: bytes) -> int:
        number = self.numbers.get((tokens[0], pending))
        if number is None:
            number = self.numbers[tokens[0], pending] = self.made
            self.states[number] = tokens, nodes, pending
            self.made += 1
        return number

    def _between(self, tokens: Sequence[int], low: int, high: int) -> tuple[int, ...]:
        """Tokens from border ``low`` to border ``high``."""
        ids = []
        while high > low:
            ids.append(tokens[high])
            high -= len(self.token[tokens[high]])
        return tuple(ids[::-1])

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        tokens, nodes, pending = self.states[state]
        n = len(nodes)
        child, pair = self.trie.get, self.pairs.get
        live, ahead, found = [], [-1] * n, -2
        for border, node in enumerate(nodes):
            if node < 0:
                continue
            node = child(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                live.append(border)
                ahead[border] = node
            if found == -2:
                token = self.ending[node]
                if token >= 0:
                    known = pair(tokens[border] << 32 | token)
                    if known or (known is None and self.stable(tokens[border], token)):
                        found = token
        tokens, nodes, pending = (*tokens, found), (*ahead, 0), pending + bytes((byte,))
        live.append(n)
        seen = set(live)
        while len(live) > 1:  # walk the last border back until all paths have met
            border = live.pop()
            border -= len(self.token[tokens[border]])
            if border not in seen:
                seen.add(border)
                insort(live, border)
        settled = live[0]
        emitted = self._between(tokens, 0, settled) if settled else ()
        kept = tuple([tokens[border] if border in seen else -2 for border in range(settled, n + 1)])
        return self._number(kept, nodes[settled:], pending[settled:]), emitted

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, ids, steps, old = 0, [], self.steps, self.old_steps
        for at, byte in enumerate(piece):
            key = state << 8 | byte
            step = steps.get(key)
            if step is None:
                step = old.get(key)
                if step is None:
                    mark = key * 0x9E3779B1 >> 7 & ASKED - 1
                    if not self.asked[mark] and len(piece) - at <= REST:
                        self.asked[mark] = 1
                        return [*ids, *self._side_by_side(state, piece[at:])]
                    step = self._step(state, byte)
                steps[key] = step
            state, emitted = step
            if emitted:
                ids += emitted
        tokens = self.states[state][0]
        ids += self._between(tokens, 0, len(tokens) - 1)
        if len(steps) > MAX_STEPS:
            self._age()
        return ids

    def _side_by_side(self, state: int, rest: bytes) -> tuple[int, ...]:
        """Ids from a state's settled border to the end of a pre-token, following all open tokens."""
        tokens, nodes, _ = self.states[state]
        tokens, end = list(tokens), len(tokens) - 1
        open_ = [(border, node) for border, node in enumerate(nodes) if node > 0]
        child, pair, ending, inner, one, two = self.trie.get, self.pairs.get, self.ending, self.inner, self.one, self.two
        last = -1  # the byte before, where a token may start there
        for byte in rest:
            found, following = -2, []
            for border, node in open_:
                node = child(node << 8 | byte)
                if node is None:
                    continue
                if inner[node]:
                    following.append((border, node))
                if found == -2 and (token := ending[node]) >= 0:
                    left = tokens[border]
                    known = pair(left << 32 | token)
                    if known or (known is None and self.stable(left, token)):
                        found = token
            if last >= 0:
                node = two[last << 8 | byte]
                if node >= 0:
                    if inner[node]:
                        following.append((end - 1, node))
                    if found == -2 and (token := ending[node]) >= 0:
                        left = tokens[end - 1]
                        known = pair(left << 32 | token)
                        if known or (known is None and self.stable(left, token)):
                            found = token
            if found == -2:
                node = one[byte]
                if node >= 0 and (token := ending[node]) >= 0:
                    left = tokens[end]
                    known = pair(left << 32 | token)
                    if known or (known is None and self.stable(left, token)):
                        found = token
            tokens.append(found)
            end += 1
            last, open_ = byte, following
        return self._between(tokens, 0, len(tokens) - 1)

    # Texts.

    @property
    def library(self) -> tiktoken.Encoding:
        if self._library is None:
            self._library = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._library

    def _piece(self, piece: str) -> bytes:
        return struct.pack(f"<{len(ids := self.merge(piece.encode()))}I", *ids)

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text: those of its pre-tokens in a row."""
        if not text:
            return np.zeros(0, "<u4")
        if NEW.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return np.array(self.library.encode_ordinary(text), "<u4")
        ids, parts, start = self.pieces.__getitem__, [], 0
        while len(text) - start > CHUNK and (cut := SAFE.search(text, start + CHUNK)):
            parts += map(ids, self.find(text[start : cut.start()]))
            start = cut.start()
        parts += map(ids, self.find(text[start:] if start else text))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids, streamed in chunks."""
        stream, parts, token = Utf8Stream(), [], self.token.__getitem__
        for start in range(0, len(ids), STREAM_IDS):
            parts.append(stream.feed(b"".join(map(token, ids[start : start + STREAM_IDS]))))
        return "".join(parts) + stream.end()


@loaded(2)
def load(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}
    return ByteBpe(ranks, pattern)


def round_trip(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row; on request ``ids, decoded``."""

    def make():
        working_for("byte ids")
        coder = load(ranks, pattern)
        gc.set_threshold(200_000, 50, 1000)  # the tables hold no cycles; the collector would walk them all
        decimal = coder.decimal.__getitem__

        def function(texts):
            counts, hashes, backs, all_ids, all_texts = [], [], [], [], []
            for t in texts:
                ids = coder.encode(t).tolist()
                decoded = coder.decode(ids)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                backs.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    all_texts.append(decoded)
            columns = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(backs, pa.string())]
            return columns + ([pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_texts, pa.string())] if with_ids else [])

        return function

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * with_ids
    return frames.map_texts(docs, make, fields, key, text)
