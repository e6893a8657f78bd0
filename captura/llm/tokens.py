"""Token ids of whole texts by the libraries of public tokenizers, with a cache of pre-tokens."""

import json
import os
import re
import unicodedata

import numpy as np

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public tokenizer's file lies on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == kind)


class _Table(dict):
    """What is known of each word; unknown words are asked for once. Two generations bound its size."""

    def __init__(self, ask, limit: int, known: dict | None = None):
        super().__init__(known or {})
        self.ask, self.limit, self.known, self.old = ask, limit, known or {}, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.ask(word)
        self[word] = value
        return value

    def trim(self) -> None:
        """Keep the words of the last generation within reach and start a new one."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
            self.update(self.known)


class Encoder:
    """Encodes texts to arrays of ids, exactly as the library does.

    For a file with the rules of the word vocabulary (white space dropped, lower case, words cut by
    letters, digits and signs), a text is split at white space and a table says what the library makes
    of each word. Texts with characters beyond Latin-1, with separators on which Python and the library
    disagree or with a special string inside, and files with other rules, go to the library whole.
    ``cache`` bounds the words of each of the table's two generations.
    """

    def __init__(self, name: str = VOCABULARY, cache: int = 250_000):
        path = vocabulary_path(name)
        self.cache, self.tables, self.pattern = cache, {}, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = model.vocab_size()
            self._encode = lambda texts: model.encode(texts, num_threads=1)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.size = tokenizer.get_vocab_size(with_added_tokens=True)
        self._encode = lambda texts: [
            e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]
        self.model, self.bytes = tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        with open(path, encoding="utf-8") as f:
            self._read_rules(json.load(f))

    def _read_rules(self, rules: dict) -> None:
        steps = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word")) for x in rules["added_tokens"])
        if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in splits] != ["Split", "ByteLevel"]:
            return
        first = splits[0]
        if not (first.get("invert") and first.get("behavior") == "Removed" and plain):
            return
        expression = first["pattern"].get("Regex", "")
        for name, chars in (("\\p{L}", _latin("L")), ("\\p{N}", _latin("N")), ("\\s", "\\t-\\r \\x85\\xa0")):
            expression = expression.replace(name, chars)
        if "\\p" in expression or "(?" in expression:
            return
        self.pattern = re.compile(expression)
        self.unsafe = re.compile("|".join(["[\\x1c-\\x1f]", *(re.escape(x["content"]) for x in rules["added_tokens"])]))

    def _word_ids(self, word: str) -> list[int]:
        out = []
        for piece in self.pattern.findall(word):
            if not (piece.isascii() and piece.isprintable()):
                piece = self.bytes.pre_tokenize_str(piece)[0][0]
            out += [t.id for t in self.model.tokenize(piece)]
        return out

    def words(self, text: str) -> list[str] | None:
        """Lower-case words between white space, or None where only the library can tell."""
        if self.pattern is None:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if self.unsafe.search(text) else text.lower().split()

    def _table(self, kind: str, ask, known: dict | None = None) -> _Table:
        if kind not in self.tables:
            self.tables[kind] = _Table(ask, self.cache, known)
        self.tables[kind].trim()
        return self.tables[kind]

    def lengths(self, texts: list[str], known: dict | None = None) -> list[int]:
        """Number of ids of each text; ``known`` maps frequent words to their number of ids."""
        table = self._table("lengths", lambda w: len(self._word_ids(w)), known)
        words = map(self.words, texts)
        return [len(self._encode([t])[0]) if w is None else sum(map(table.__getitem__, w)) for t, w in zip(texts, words)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        table = self._table("ids", lambda w: np.asarray(self._word_ids(w), "<u4").tobytes())
        rows = []
        for text in texts:
            words = self.words(text)
            if words is None:
                rows.append(np.asarray(self._encode([text])[0], "<u4"))
            else:
                rows.append(np.frombuffer(b"".join(map(table.__getitem__, words)), "<u4"))
        return rows
