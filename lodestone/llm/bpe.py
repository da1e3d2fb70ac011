"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Encoding: a text is cut before every space that precedes a non-space, where the pretokenising pattern always starts a new
match; pieces not seen before are matched with the pattern, and matches not seen before go to DuckDB as rows (word,
position, token), one per byte. A recursive query joins neighbouring tokens to the merge table and contracts in each word
the leftmost pair of minimum rank, until no word has a pair left.
Decoding: (part, position, id) rows join the vocabulary, and an ordered aggregation puts the pieces together.

Words beyond LONG bytes (a match may be a whole text, where a script has no spaces) go to the same query as windows of WINDOW
bytes, each beginning STRIDE bytes after the one before. Neighbouring windows are joined at a token that both have at the same
place. That is exact: a row of tokens is the encoding of its bytes if every two neighbours are the encoding of theirs, and at a
common token all neighbours come from one window or the other. (A merge across a border between two tokens of the row would,
up to the first such, see nothing but the two tokens' own merges, so it would happen when the two are encoded alone.) Where two
windows have no token in common, which takes a long period out of step with STRIDE, a wider window begins at a token's start
instead; it contracts, in one step, the occurrences of the minimum pair from left to right, as far as merging one by one would
do nothing else in between.

Memory: texts are worked on by slices of about SLICE characters, a query gets a bounded number of rows and of rows times steps,
and a long text is decoded part by part, so a text may be as long as its row. Each Python worker holds one DuckDB connection of
bounded memory and a bounded cache of pieces; both can be lost at any time. What a batch took goes back to the system after it, as
a worker shares its executor's limit with the JVM, whose heap earlier stages have grown. Nothing is written to disk.

Defined cases: a null or empty text has no ids and decodes to the empty text; ids are decoded to bytes (base64 of nothing,
no replacement characters), so parts of characters survive; an id outside the vocabulary raises; a null list of ids
decodes to nothing; repeated rows come out as often as they came in; an empty table gives no rows. Special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import batches_of, give_back, held

#: Words of more bytes are contracted in windows of so many, each beginning so many after the one before.
LONG = WINDOW = 96
STRIDE = 64
#: The first size of a window that begins at a token, where two others have none in common.
RESTART = 4096
#: A worker forgets its pieces beyond this number, or beyond so many characters.
PIECES, PIECES_CHARS = 300_000, 50 << 20
#: A worker remembers the ids of contracted words (of LONG bytes at most): so many that were used lately, and as many from before.
WORDS = 60_000
#: Rows for one query: bytes of words, ids to decode. A query of words also gets so many rows times bytes of its longest word at most.
STEP_ROWS, STEP_WORK = 150_000, 2_000_000
#: Characters of a text that are worked on at a time.
SLICE = 1 << 20
#: Bytes of texts that are encoded at a time (fewer take less memory and more queries), and pieces whose ids are put together at a time.
BATCH, PLACES = 4 << 20, 1 << 16

# pos counts bytes over all words; next is the place of the token that follows, -1 after a word's last one
CONTRACT = """
WITH RECURSIVE t(w, pos, next, tok, step) AS (
  SELECT w, pos::INTEGER, if(pos = last, -1, pos + 1)::INTEGER, tok, 0 FROM (SELECT *, max(pos) OVER (PARTITION BY w) AS last FROM given)
  UNION ALL
  SELECT t.w, t.pos, if(t.pos = b.best & 4294967295, b.next, t.next), if(t.pos = b.best & 4294967295, (b.best >> 32)::INTEGER, t.tok), t.step + 1
  FROM t JOIN (SELECT l.w, min((m.ab::BIGINT << 32) | l.pos) AS best, arg_min(r.pos, (m.ab::BIGINT << 32) | l.pos) AS gone, arg_min(r.next, (m.ab::BIGINT << 32) | l.pos) AS next
               FROM t l JOIN t r ON l.next = r.pos JOIN merges m ON m.a = l.tok AND m.b = r.tok GROUP BY l.w) b ON t.w = b.w
  WHERE t.pos <> b.gone)
SELECT t.w, t.tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY pos
"""

# hit: the pair at pos has the word's minimum rank; run: neighbouring hits (they overlap), of which every other one is
# chosen. A merge one by one would go on with the next hit unless the merge before has made a pair of smaller rank, with
# its left neighbour (merged, if that was chosen) or with its right one (not merged yet): hits after the first such are left.
CONTRACT_LONG = """
WITH RECURSIVE t(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM given
  UNION ALL
  SELECT w, pos, if(taken, least_ab, tok), step + 1
  FROM (SELECT w, pos, tok, step, least_ab, taken, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY pos), false) AS eaten
        FROM (SELECT *, chosen AND pos <= coalesce(min(if(chosen AND (r.ab < least_ab OR l.ab < least_ab), pos, NULL)) OVER (PARTITION BY w), pos) AS taken
              FROM (SELECT *, if(coalesce(lag(chosen, 2) OVER (PARTITION BY w ORDER BY pos), false), least_ab, lag(tok) OVER (PARTITION BY w ORDER BY pos)) AS left_tok
                    FROM (SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY pos) % 2 = 1 AS chosen
                          FROM (SELECT *, sum(if(hit, 0, 1)) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
                                FROM (SELECT *, coalesce(pair_ab = least_ab, false) AS hit
                                      FROM (SELECT n.*, m.ab AS pair_ab, min(m.ab) OVER (PARTITION BY n.w) AS least_ab
                                            FROM (SELECT w, pos, tok, step, lead(tok) OVER s AS next, lead(tok, 2) OVER s AS right_tok FROM t WHERE step < 40 WINDOW s AS (PARTITION BY w ORDER BY pos)) n
                                            LEFT JOIN merges m ON m.a = n.tok AND m.b = n.next)
                                      WHERE least_ab IS NOT NULL)))) c
              LEFT JOIN merges r ON c.chosen AND r.a = c.least_ab AND r.b = c.right_tok
              LEFT JOIN merges l ON c.chosen AND l.a = c.left_tok AND l.b = c.least_ab))
  WHERE NOT eaten)
SELECT w, tok, step FROM (SELECT w, pos, tok, step FROM t QUALIFY step = max(step) OVER (PARTITION BY w)) ORDER BY w, pos
"""

DECODE = "SELECT d, string_agg(piece, '' ORDER BY pos) AS text FROM given JOIN vocabulary USING (id) GROUP BY d ORDER BY d"


def taken(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[begin[p] : begin[p] + size[p]] for each p in places, one after the other, and their lengths."""
    n = size[places]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin[places] - (ends - n), n) + np.arange(total)], n


class Codec:
    """The tables of one rank file, in DuckDB, and the pieces seen so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": "false"})
        by_id = sorted((i, t) for t, i in self.ranks.items())
        self.known = {i for i, _ in by_id}
        vocabulary = pa.table({"id": pa.array([i for i, _ in by_id], pa.int32()), "piece": [t.decode("latin-1") for _, t in by_id]})
        rows = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for i, t in by_id for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        a, b, ab = zip(*rows, strict=True)
        merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "ab": pa.array(ab, pa.int32())})
        for name, data in (("vocabulary", vocabulary), ("merges", merges)):
            self.db.register("given", data)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.width = np.zeros(by_id[-1][0] + 1, np.int64)
        self.width[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        self.later: dict[str, int] = {}  # pieces that follow a space
        self.first: dict[str, int] = {}  # pieces at the start of a text
        # the ids of piece k are flat[begin[k] : begin[k + 1]]
        self.flat, self.begin, self.uses = NOTHING, np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.chars = 0
        self.words: dict[bytes, bytes] = {}  # ids as bytes
        self.words_before: dict[bytes, bytes] = {}

    def forget_rare(self) -> None:
        """Keep the pieces used more than once since they were learnt or last counted, at most half of the bound."""
        keep = np.flatnonzero(self.uses > 1)
        keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: PIECES // 2]])
        place = np.full(len(self.uses), -1)
        place[keep] = np.arange(len(keep))
        new = place.tolist()
        self.later = {p: new[k] for p, k in self.later.items() if new[k] >= 0}
        self.first = {p: new[k] for p, k in self.first.items() if new[k] >= 0}
        self.flat, sizes = taken(self.flat, self.begin, np.diff(self.begin), keep)
        self.begin, self.uses = np.concatenate(([0], np.cumsum(sizes))), np.zeros(len(keep), np.int64)
        self.chars = sum(map(len, self.later)) + sum(map(len, self.first))
        if self.chars > PIECES_CHARS:
            self.forget()

    def query(self, sql: str, table: pa.Table) -> pa.Table:
        self.db.register("given", table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister("given")

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the words, in some order of the words: which word, how many ids, and the ids one after the other."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")  # a query takes as many steps as its longest word
        order, long = order[lengths[order] <= LONG], order[lengths[order] > LONG]
        before = np.concatenate(([0], np.cumsum(lengths[order])))
        at, flat, counts = 0, [NOTHING], [np.zeros(0, np.int64)]
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(before, before[at] + STEP_ROWS, side="right")) - 1)
            to = max(at + 1, min(to, int(np.searchsorted(before, before[at] + STEP_WORK // lengths[order[to - 1]], side="right")) - 1))
            found = self.query(CONTRACT, self.rows(np.frombuffer(b"".join([words[i] for i in order[at:to].tolist()]), np.uint8), lengths[order[at:to]]))
            flat.append(found.column("tok").to_numpy())
            counts.append(np.bincount(found.column("w").to_numpy(), minlength=to - at))
            at = to
        if len(long):
            for ids in self.contract_long([words[i] for i in long.tolist()]):
                flat.append(ids)
                counts.append(np.array([len(ids)]))
        return np.concatenate((order, long)), np.concatenate(counts), np.concatenate(flat)

    def whole(self, word: bytes) -> np.ndarray:
        """The ids of one word of any length, all occurrences of a pair in a step."""
        found = self.query(CONTRACT_LONG, self.rows(np.frombuffer(word, np.uint8), np.array([len(word)])))
        while found.column("step")[0].as_py() == 40:  # as many steps as one query takes
            found = self.query(CONTRACT_LONG, self.rows(found.column("tok").to_numpy(), np.array([len(found)]), True))
        return found.column("tok").to_numpy()

    def contract_long(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each word, put together from windows."""
        pieces: dict[bytes, int] = {}
        places = []
        for word in words:
            own = []
            for start in range(0, max(1, len(word) - WINDOW + STRIDE + 3), STRIDE):
                a = character(word, start)
                own.append((a, pieces.setdefault(word[a : character(word, a + WINDOW)], len(pieces))))
            places.append(own)
        which, counts, flat = self.contract(list(pieces))
        begin = np.empty(len(pieces) + 1, np.int64)
        count = np.empty(len(pieces), np.int64)
        begin[which], count[which] = np.cumsum(counts) - counts, counts
        for word, own in zip(words, places, strict=True):
            yield self.joined(word, [(a, flat[begin[p] : begin[p] + count[p]]) for a, p in own])

    def joined(self, word: bytes, windows: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """The ids of a word from those of its windows (start, ids)."""
        out, (at, tokens) = [], windows[0]
        ends = at + np.cumsum(self.width[tokens])
        k, size = 1, RESTART
        while ends[-1] < len(word):
            # ends, tokens: what is taken from one window so far. Go on with the first window that reaches beyond it
            while k < len(windows) and windows[k][0] + self.width[windows[k][1]].sum() <= ends[-1]:
                k += 1
            start, others = windows[k]
            other_ends = start + np.cumsum(self.width[others])
            same = common(ends, self.width[tokens], other_ends, self.width[others])
            if same is None:  # a wider window from a token's start on, not too near the end
                first = int(np.searchsorted(ends, ends[-1] - WINDOW // 3)) if size == RESTART else 0
                start = int(ends[first] - self.width[tokens[first]])
                others = self.whole(word[start : character(word, start + size)])
                other_ends = start + np.cumsum(self.width[others])
                if other_ends[-1] == len(word) and first == 0 and others[0] != tokens[0]:
                    return self.whole(word)
                size *= 2
                if others[0] != tokens[first] or other_ends[-1] <= ends[-1]:
                    continue
                same = (first, 0)
            else:
                k += 1
            size = RESTART
            out.append(tokens[: same[0]])  # the common token itself stays, to begin what is taken from the other window
            tokens, ends = others[same[1] :], other_ends[same[1] :]
        return np.concatenate((*out, tokens))

    def rows(self, tokens: np.ndarray, n: np.ndarray, ids: bool = False) -> pa.Table:
        """(w, pos, tok) of words whose n bytes (or ids) stand one after the other."""
        return pa.table({"w": pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), "pos": pa.array(np.arange(len(tokens))), "tok": pa.array(tokens if ids else self.byte_id[tokens])})

    def learn(self, pieces: list[str]) -> None:
        """Appends the ids of each piece, by way of its words."""
        words: dict[str, int] = {}
        parts, counts = [], []
        findall, place = self.pattern.findall, words.setdefault
        for p in pieces:
            found = findall(p)
            counts.append(len(found))
            for w in found:
                parts.append(place(w, len(words)))
        raw = [w.encode() for w in words]
        whole = np.array([self.ranks.get(w, -1) for w in raw], np.int32)
        rest = np.flatnonzero(whole < 0)
        found = self.word_ids([raw[i] for i in rest.tolist()])
        size, begin = np.ones(len(raw), np.int64), np.arange(len(raw))
        size[rest] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin[rest] = len(raw) + np.cumsum(size[rest]) - size[rest]
        flat, sizes = taken(np.concatenate((whole, np.frombuffer(b"".join(found), np.int32))), begin, size, np.array(parts, np.int64))
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        self.flat, self.begin = np.concatenate((self.flat, flat)), np.concatenate((self.begin, self.begin[-1] + ends))
        self.uses = np.concatenate((self.uses, np.zeros(len(pieces), np.int64)))
        self.chars += sum(map(len, pieces))

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes."""
        found = list(map(self.words.get, words))
        new = []
        for i, (word, ids) in enumerate(zip(words, found, strict=True)):
            if ids is None:
                ids = self.words_before.get(word)
                if ids is None:
                    new.append(i)
                else:
                    found[i] = self.words[word] = ids
        which, sizes, flat = self.contract([words[i] for i in new])
        data, ends = flat.astype(np.int32).tobytes(), 4 * np.cumsum(sizes)
        for k, a, b in zip(which.tolist(), (ends - 4 * sizes).tolist(), ends.tolist(), strict=True):
            i = new[k]
            found[i] = data[a:b]
            if len(words[i]) <= LONG:
                self.words[words[i]] = found[i]
        if len(self.words) > WORDS:
            self.words_before, self.words = self.words, {}
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the number of ids of each text."""
        ids, counts, group, size = [NOTHING], np.zeros(len(texts), np.int64), [], 0

        def flush() -> None:
            found, n = self.encode_slices([t for _, t in group])
            ids.append(found)
            np.add.at(counts, [i for i, _ in group], n)
            group.clear()

        for i, text in enumerate(texts):
            for part in slices(text or ""):
                group.append((i, part))
                size += len(part)
                if size >= 4 * SLICE:
                    flush()
                    size = 0
        if group:
            flush()
        return np.concatenate(ids), counts

    def encode_slices(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that together are of bounded length, and the number of ids of each."""
        if len(self.uses) > PIECES or self.chars > PIECES_CHARS:
            self.forget_rare()
        later, first = self.later, self.first
        new: dict[str, int] = {}
        known = len(self.uses)
        places, counts = [], []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            pieces = BEFORE_WORD.split(text) if SPACES.search(text) else text.split(" ")
            own = list(map(later.get, pieces))
            head = pieces[0]
            own[0] = first.get(head)
            if own[0] is None:
                own[0] = first[head] = new.setdefault(head, known + len(new))
            if None in own:
                for i, k in enumerate(own):
                    if k is None:
                        p = pieces[i]
                        k = later.get(p)
                        own[i] = later[p] = new.setdefault(" " + p, known + len(new)) if k is None else k
            places += own
            counts.append(len(own))
        if new:
            try:
                self.learn(list(new))
            except BaseException:
                self.forget()
                raise
        places = np.array(places, np.int64)
        self.uses += np.bincount(places, minlength=len(self.uses))
        sizes = np.diff(self.begin)
        ids = [taken(self.flat, self.begin, sizes, places[at : at + PLACES])[0] for at in range(0, len(places), PLACES)]
        edges = np.concatenate(([0], np.cumsum(sizes[places])))[np.concatenate(([0], np.cumsum(counts)))]
        return np.concatenate((NOTHING, *ids)), np.diff(edges)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids; ids holds all lists one after the other."""
        out: list[list[bytes]] = [[] for _ in counts]
        begin = np.concatenate(([0], np.cumsum(counts)))
        # long lists are decoded in parts; a query gets parts of STEP_ROWS ids together
        parts = -(-counts // STEP_ROWS)
        text = np.repeat(np.arange(len(counts)), parts)
        start = begin[text] + STEP_ROWS * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
        ends, at = np.append(start[1:], len(ids)), 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(ends, start[at] + STEP_ROWS, side="right")))
            part = ids[start[at] : ends[to - 1]]
            given = pa.table({"d": pa.array(np.repeat(np.arange(at, to), ends[at:to] - start[at:to])), "pos": pa.array(np.arange(len(part))), "id": pa.array(part)})
            found = self.query(DECODE, given)
            if len(found) < to - at or not self.known.issuperset(np.unique(part).tolist()):
                raise ValueError("an id is not in the vocabulary")
            for d, piece in zip(found.column("d").to_pylist(), found.column("text").to_pylist(), strict=True):
                out[text[d]].append(piece.encode("latin-1"))
            at = to
        return [b"".join(x) for x in out]


def slices(text: str) -> list[str]:
    """The text cut into about SLICE characters each, before spaces that precede a non-space."""
    out, at = [], 0
    while len(text) - at > SLICE and (m := BEFORE_WORD.search(text, at + SLICE)):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:] if at else text)
    return out


def character(word: bytes, at: int) -> int:
    """The last start of a character up to that byte, or the word's end."""
    if at >= len(word):
        return len(word)
    while word[at] & 0xC0 == 0x80:
        at -= 1
    return at


def common(ends: np.ndarray, widths: np.ndarray, other_ends: np.ndarray, other_widths: np.ndarray) -> tuple[int, int] | None:
    """Positions of the last token that both have at the same place, if there is one."""
    _, i, j = np.intersect1d(ends, other_ends, assume_unique=True, return_indices=True)
    same = np.flatnonzero(widths[i] == other_widths[j])
    return (int(i[same[-1]]), int(j[same[-1]])) if len(same) else None


#: A piece begins at each space that a non-space follows.
BEFORE_WORD = re.compile(r" (?=\S)")
SPACES = re.compile(r" \s| $")
NOTHING = np.zeros(0, np.int32)


def codec(path: str, pattern: str) -> Codec:
    """This process's codec for a rank file."""
    codecs = held("bpe")
    if (path, pattern) not in codecs:
        give_back()  # what stages before have left
        codecs[path, pattern] = Codec(path, pattern)
    return codecs[path, pattern]


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int64()), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of every document; ids as the rank file's library would give without special tokens."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches_of(batches, "text", BATCH, owner="bpe"):
            ids, counts = own.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids, counts)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, limit: int = BATCH) -> DataFrame:
    """(doc_id, ids, decoded) of every document, decoded from the ids: encode and decode in one worker, which holds the tables once.
    limit: bytes of texts at a time."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches_of(batches, "text", limit, owner="bpe"):
            ids, counts = own.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids, counts), pa.array(own.decode(ids, counts), pa.binary())], names=["doc_id", "ids", "decoded"])

    kind = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, decoded), decoded being binary."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches_of(batches, "ids", owner="bpe"):
            given = batch.column("ids")
            counts = np.array([x or 0 for x in pa.compute.list_value_length(given).to_pylist()], np.int64)
            decoded = own.decode(given.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), given, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    kind = T.StructType([encoded.schema["doc_id"], encoded.schema["ids"], T.StructField("decoded", T.BinaryType())])
    return encoded.select("doc_id", "ids").mapInArrow(run, kind)
