"""BPE encoding and decoding by speculation and verification.

Words of a batch that are not known yet are first split by greedy longest match, all at once. A split is the true
BPE result if every adjacent pair of its tokens is compatible, that is if merging the pair's own letters gives the
pair again (a merge sequence can cross a token border only if it does so between the two tokens that meet there).
The pairs of all words are looked up in a sorted table of verdicts in one vectorised search; pairs not met before
are judged by merging their few letters. Only words with an incompatible pair go through the exact merges.

Files are those of the tokenizers library of the form BPE with an end-of-word suffix (or none), byte-level letters,
NFC, white space and lower-case normalisers and a splitting pattern. Nulls count as empty texts; an empty text has
no tokens and decodes to an empty one. Special tokens inside a text keep their own ids, as in the library. Any
other column of the input, also one named as an output, passes unread. Very long texts are handled like others:
a text is one list of words, and words repeat."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean

#: Words kept with their tokens within a task; beyond it the table starts anew.
KEPT_WORDS = 600_000
#: Pairs of tokens kept with their verdicts.
KEPT_PAIRS = 400_000
#: Texts handled at once, in characters.
AT_ONCE = 1_000_000
#: Rows of a batch that goes back at once.
ROWS = 500


#: Letters from which a word is merged by a heap of its own.
LONG = 300
NEVER = np.int64(1) << 62


def merged_long(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The exact merges of one long word: a heap of (rank, place) over a linked list of its tokens."""
    n = len(ids)
    ids, after, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if ids[i] is not None else -1
        if j < 0 or (ids[i], ids[j]) != pair:
            continue
        ids[i], ids[j] = merges[pair][1], None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in merges:
                heapq.heappush(heap, (merges[p][0], a, p))
    return [t for t in ids if t is not None]


SPACES = regex.compile(r"\p{White_Space}+")
ODD = regex.compile("[\x1c-\x1f]")


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places first[i] .. first[i] + sizes[i] - 1, one stretch after the other."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(total)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(other)) for b in range(256)]


class SpeculativeBpe:
    """One tokenizer file, with encode() and decode() for lists of texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE file without byte fallback, dropout or subword prefixes is needed")
        if spec.get("post_processor") or spec.get("decoder"):
            raise ValueError("a file without post-processor and decoder is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.names: dict[int, str] = {i: t for t, i in self.vocab.items()}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        v = self.vocab
        self.merges = {(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.fromiter(((a << 32) | b for a, b in self.merges), np.int64, len(self.merges))
        order = np.argsort(keys)
        self.merge_keys = keys[order]
        self.merge_ranks, self.merge_new = (np.fromiter((m[i] for m in self.merges.values()), np.int64, len(keys))[order] for i in (0, 1))
        #: Whether a token comes out of merging its own letters; others can't be in a result.
        self.sound: dict[int, bool] = {}
        self._plant()
        self.normal = self._normaliser(spec.get("normalizer"))
        self.pieces = self._splitter(spec["pre_tokenizer"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: What each token spells, as letters of bytes; used for the verdicts on pairs.
        self.spelled: dict[int, list[int]] = {}
        self._forget_words()
        self._forget_runs()
        self._forget_pairs()
        self.counts = {"words": 0, "merged": 0}
        self.kept_words = KEPT_WORDS

    @staticmethod
    def _normaliser(spec: dict | None):
        kinds = [n["type"] for n in (spec or {}).get("normalizers", [spec] if spec else [])]
        if any(k not in ("NFC", "Replace", "Lowercase") for k in kinds):
            raise ValueError(f"normalisers {kinds} are not known")

        def run(text: str) -> str:
            for k in kinds:
                if k == "NFC" and not text.isascii():
                    text = unicodedata.normalize("NFC", text)
                elif k == "Lowercase":
                    # Letter by letter: a capital sigma never becomes a final one.
                    text = text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()
            return text  # Replace turns white space into blanks, which the splitter drops anyway

        return run

    @staticmethod
    def _splitter(spec: dict):
        first = spec["pretokenizers"][0]
        if first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"]:
            raise ValueError("a splitter that keeps what its pattern matches is needed")
        # \s of the library is Unicode white space; regex's own \s has four control characters besides.
        pattern = first["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
        return regex.compile(pattern).findall

    def _forget_words(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.decoded = np.zeros(0, np.uint32), np.zeros(1, np.int64), []

    def _forget_runs(self) -> None:
        self.run_index: dict[str, int] = {}
        self.run_ids, self.run_starts, self.run_decoded = np.zeros(0, np.uint32), np.zeros(1, np.int64), []

    def _forget_pairs(self) -> None:
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def _units(self, word: str) -> list[str]:
        """The letters of a word, the last with the suffix."""
        units = [self.letters[b] for b in word.encode("utf-8")]
        units[-1] += self.suffix
        return units

    def merged(self, words: list[list[int]]) -> list[list[int]]:
        """The exact merges of many words at once: in each round every word merges the leftmost of its pairs of lowest rank.

        Words of more than LONG letters take a heap of pairs instead, so that none costs the square of its length."""
        out: list[list[int]] = [merged_long(w, self.merges) if len(w) > LONG else w for w in words]
        left = [i for i, w in enumerate(words) if 1 < len(w) <= LONG]
        if not left:
            return out
        ids = np.fromiter((t for i in left for t in words[i]), np.int64)
        of = np.repeat(np.arange(len(left)), np.fromiter((len(words[i]) for i in left), np.int64, len(left)))
        while True:
            keys = (ids[:-1] << 32) | ids[1:]
            at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
            rank = np.where((self.merge_keys[at] == keys) & (of[1:] == of[:-1]), self.merge_ranks[at], NEVER)
            rank = np.append(rank, NEVER)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            low = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(ids)))
            going = low < NEVER
            hit = np.flatnonzero((rank == np.repeat(low, sizes)) & np.repeat(going, sizes))
            hit = hit[np.append(True, of[hit][1:] != of[hit][:-1])] if len(hit) else hit
            for w, a, n in zip(of[first][~going].tolist(), first[~going].tolist(), sizes[~going].tolist(), strict=True):
                out[left[w]] = ids[a : a + n].tolist()
            if not len(hit):
                return out
            ids[hit] = self.merge_new[at[hit]]
            keep = np.repeat(going, sizes)
            keep[hit + 1] = False
            ids, of = ids[keep], of[keep]

    def _letters_of(self, token: int) -> list[int]:
        if token not in self.spelled:
            name = self.names[token]
            body = name.removesuffix(self.suffix) if self.suffix else name
            units = list(body)
            if self.suffix and name.endswith(self.suffix):
                units[-1] += self.suffix
            self.spelled[token] = [self.vocab[u] for u in units]
        return self.spelled[token]

    def _plant(self) -> None:
        """The vocabulary as a trie of byte letters: sorted edges, and at each node the token that ends there, inside and at the end of a word."""
        byte = {c: i for i, c in enumerate(self.letters)}
        nodes, edges, inside, at_end = {"": 0}, {}, {}, {}
        for token, i in self.vocab.items():
            last = self.suffix and token.endswith(self.suffix) and token != self.suffix
            body = token.removesuffix(self.suffix) if last else token
            node = 0
            if not all(c in byte for c in body):
                continue
            for n, c in enumerate(body, 1):
                child = nodes.setdefault(body[:n], len(nodes))
                edges[node << 8 | byte[c]] = child
                node = child
            if last or not self.suffix:
                at_end[node] = i
            if not last:
                inside[node] = i
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.inside, self.at_end = np.full(len(nodes), -1), np.full(len(nodes), -1)
        self.inside[list(inside)], self.at_end[list(at_end)] = list(inside.values()), list(at_end.values())

    def _propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match from the left, all words a letter further in each step: the tokens joined up and their number by word (0: no match)."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw) + b"\0", np.uint8).astype(np.int64)
        stop = np.cumsum(sizes)
        word = np.flatnonzero(sizes)
        place, stop = (stop - sizes)[word], stop[word]
        node, best, best_at = np.zeros(len(word), np.int64), np.full(len(word), -1), np.zeros(len(word), np.int64)
        lost, found_words, found = np.zeros(len(words), bool), [], []
        while len(word):
            keys = node << 8 | data[place]
            at = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            on = (self.edge_keys[at] == keys) & (place < stop)
            node = np.where(on, self.edge_to[at], node)
            place = place + on
            token = np.where(place == stop, self.at_end[node], self.inside[node])
            got = on & (token >= 0)
            best, best_at = np.where(got, token, best), np.where(got, place, best_at)
            cut = np.flatnonzero(~on)
            if len(cut):
                lost[word[cut[best[cut] < 0]]] = True
                cut = cut[best[cut] >= 0]
                found_words.append(word[cut])
                found.append(best[cut])
                place[cut], node[cut], best[cut] = best_at[cut], 0, -1
                going = ~lost[word]
                going[cut] &= place[cut] < stop[cut]
                if not going.all():
                    word, place, stop, node, best, best_at = (x[going] for x in (word, place, stop, node, best, best_at))
        of = np.concatenate([*found_words, np.zeros(0, np.int64)])
        order = np.argsort(of, kind="stable")
        order = order[~lost[of[order]]]
        return np.concatenate([*found, np.zeros(0, np.int64)])[order], np.bincount(of[order], minlength=len(words))

    def _compatible(self, keys: np.ndarray) -> np.ndarray:
        """The verdict on each pair, first * 2**32 + second."""
        at = np.minimum(np.searchsorted(self.pairs, keys), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == keys if len(self.pairs) else np.zeros(len(keys), bool)
        if not known.all():
            new = np.unique(keys[~known])
            if len(self.pairs) + len(new) > KEPT_PAIRS:
                self._forget_pairs()
                new = np.unique(keys)
            both = [[k >> 32, k & 0xFFFFFFFF] for k in new.tolist()]
            fits = np.fromiter((g == p for g, p in zip(self.merged([self._letters_of(a) + self._letters_of(b) for a, b in both]), both, strict=True)), bool, len(new))
            pairs = np.concatenate([self.pairs, new])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.fits = pairs[order], np.concatenate([self.fits, fits])[order]
            at = np.searchsorted(self.pairs, keys)
        return self.fits[at]

    def _learn(self, words: list[str]) -> None:
        """Tokens of words not known yet: proposed one by one, verified all at once, merged where that fails."""
        ids, sizes = self._propose(words)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        bad = sizes == 0
        if len(ids) > 1:
            of = np.repeat(np.arange(len(words)), sizes)
            inner = of[1:] == of[:-1]
            good = self._compatible((ids[:-1][inner] << 32) | ids[1:][inner])
            bad[of[1:][inner][~good]] = True
        # A pair of tokens that fits shows that both are sound; a word of one token has no pair.
        alone = np.flatnonzero(sizes == 1)
        if unseen := sorted(set(ids[edge[alone]].tolist()).difference(self.sound)):
            self.sound.update((t, g == [t]) for t, g in zip(unseen, self.merged([self._letters_of(t) for t in unseen]), strict=True))
        bad[alone] = [not self.sound[t] for t in ids[edge[alone]].tolist()]
        failed = np.flatnonzero(bad).tolist()
        whole, tokens = ids.tolist(), edge.tolist()
        proposed = [whole[a:b] for a, b in zip(tokens, tokens[1:], strict=False)]
        for i, got in zip(failed, self.merged([[self.vocab[u] for u in self._units(words[i]) if u in self.vocab] for i in failed]), strict=True):
            proposed[i] = got
        self.counts["words"] += len(words)
        self.counts["merged"] += int(bad.sum())
        if bad.any():
            sizes = np.fromiter(map(len, proposed), np.int64, len(words))
            ids = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
            edge = np.concatenate([[0], np.cumsum(sizes)])
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + edge[1:]])
        names = self.names
        self.decoded += [" ".join([names[t] for t in p]) for p in proposed]

    def _runs(self, text: str) -> list[str]:
        """The runs without white space; no piece of the splitter crosses them. Special tokens stand behind a blank."""
        if self.cut is not None and any(t in text for t in self.special):
            out: list[str] = []
            for part in self.cut.split(text):
                out += [" " + part] if part in self.special else self._runs(part)
            return out
        text = self.normal(text)
        # str.split also parts at four control characters, which are no white space to the library.
        return [x for x in SPACES.split(text) if x] if ODD.search(text) else text.split()

    def _pieces_known(self, lots: list[list[str]]) -> None:
        """Have all pieces in the word table."""
        if new := {p for pieces in lots for p in pieces}.difference(self.index):
            self._learn(sorted(new))

    def _runs_known(self, runs: set[str]) -> None:
        """Put runs into the table of runs: the tokens of their pieces, joined up."""
        marks = {r for r in runs if r[0] == " "}
        runs = sorted(runs - marks)
        lots = [[r] if r.isalpha() else self.pieces(r) for r in runs]
        if len(self.index) > self.kept_words:
            self._forget_words()
        self._pieces_known(lots)
        flat = np.fromiter((self.index[p] for pieces in lots for p in pieces), np.int64)
        of = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lots), np.int64, len(lots)))])
        first, sizes = self.starts[flat], self.starts[flat + 1] - self.starts[flat]
        ids = self.ids[spread(first, sizes)]
        edge = np.concatenate([[0], np.cumsum(sizes)])[of]
        for r, pieces in zip(runs, lots, strict=True):
            self.run_index[r] = len(self.run_index)
            self.run_decoded.append(self.decoded[self.index[pieces[0]]] if len(pieces) == 1 else " ".join([self.decoded[self.index[p]] for p in pieces]))
        for m in sorted(marks):
            self.run_index[m] = len(self.run_index)
            self.run_decoded.append(m[1:])
            ids, edge = np.append(ids, np.uint32(self.special[m[1:]])), np.append(edge, len(ids) + 1)
        self.run_ids = np.concatenate([self.run_ids, ids])
        self.run_starts = np.concatenate([self.run_starts, self.run_starts[-1] + edge[1:]])

    def batches(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        lot, size = [], 0
        for t in texts:
            lot.append(self._runs(t or ""))
            size += len(t or "")
            if size >= AT_ONCE:
                yield lot
                lot, size = [], 0
        if lot:
            yield lot

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids (unsigned 32-bit) and decoded text of each text."""
        for lot in self.batches(texts):
            if len(self.run_index) > self.kept_words:
                self._forget_runs()
            if new := set().union(*lot).difference(self.run_index):
                self._runs_known(new)
            decoded = self.run_decoded
            for runs in lot:
                known = list(map(self.run_index.__getitem__, runs))
                at = np.array(known, np.int64)
                first = self.run_starts[at]
                # Runs of no piece have no tokens and no place in the decoded text.
                yield self.run_ids[spread(first, self.run_starts[at + 1] - first)], " ".join([d for i in known if (d := decoded[i])])

    def decode(self, ids) -> str:
        """Tokens joined by blanks, as the library does for a file without a decoder; unknown ids are left out."""
        return " ".join(self.names[i] for i in map(int, ids) if i in self.names)


_loaded: dict[str, SpeculativeBpe] = {}


def codec(path: str) -> SpeculativeBpe:
    if path not in _loaded:
        _loaded[path] = SpeculativeBpe(path)
    return _loaded[path]


def forget_codecs() -> None:
    """Between tasks a worker holds no tables; the next one makes them anew."""
    _loaded.clear()


def encode_column(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Columns `keep` and of each row n_tokens, ids (array<int>, if with_ids), ids_sha256, decoded_sha256.

    One pass without a shuffle. Decoding takes the encoded ids, word by word, through the same tables. kept_words: how
    many words a worker keeps, its memory (about 1 KB a word) against meeting them again; results don't depend on it."""
    kept = [df.schema[c] for c in keep]

    def encoded(bpe: SpeculativeBpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(kept)).to_pylist()
        sizes, ids, one, two = [], [], [], []
        for got, back in bpe.encode(texts):
            sizes.append(len(got))
            raw = got.astype("<u4").tobytes()
            one.append(hashlib.sha256(raw).hexdigest())
            two.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            if with_ids:
                ids.append(got.astype(np.int32))
        out = [batch.column(i) for i in range(len(kept))] + [pa.array(sizes, pa.int64())]
        if with_ids:
            edge = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))))
        out += [pa.array(one, pa.string()), pa.array(two, pa.string())]
        return pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        bpe.kept_words = kept_words
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                yield encoded(bpe, whole.slice(lo, ROWS))
        del bpe
        forget_codecs()

    names = [*keep, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long", *(["ids array<int>"] if with_ids else []), "ids_sha256 string", "decoded_sha256 string"])
    return df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"]).mapInArrow(lean(run), ddl)
