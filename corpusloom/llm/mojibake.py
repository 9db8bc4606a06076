"""Problem 7: garbled text from a wrong character encoding."""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import columns, map_rows, spread

#: Characters outside ASCII that clean text of the five languages is made of.
CLEAN = "àâäáãåæçéèêëíìîïñóòôöõœúùûüßÿÀÂÄÁÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕŒÚÙÛÜŸ€£©®°§«»‹›“”„‘’‚–—…•·¿¡ºª½¼¾²³¹±×÷µ´¨™†‡≤≥   "
SYMBOLS = "😀🚀✅👍❤⭐✔➡→←↑↓★☆✓✗"
#: Letters of other languages whose UTF-8 bytes are looked for as well: Latin Extended-A, Greek and Cyrillic.
FURTHER = "".join(map(chr, (*range(0x100, 0x180), *range(0x386, 0x3CF), *range(0x401, 0x460)))).replace("΋", "").replace("΍", "")

#: (encoding a text was written in, encoding it was read as).
PAIRS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp850"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp1250"),
    ("utf-8", "iso8859-15"), ("cp1252", "cp1251"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "koi8-r"), ("cp1252", "iso8859-5"),
    ("cp1252", "cp1250"), ("cp850", "cp1252"), ("cp850", "latin-1"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"),
)

#: Pairs that win a tie, likeliest first.
PRIOR = (("cp1252", "cp1251"), ("cp850", "cp1252"), ("mac_roman", "cp1252"))

#: A pair must make clean words of so large a part of the wrong words of a line.
LEAST_CLEANED = 2 / 3
#: So many different words of letters that other living languages have must come out clean by one pair before they are evidence.
LEAST_WORDS = 3

_HARD = re.compile("[�\x80-\x9f]")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_TOKEN = re.compile(r"[^ \t\r\n;|]*[^\x00-\x7f][^ \t\r\n;|]*")  # cells are words of their own
#: Greek and Cyrillic letters: wrong within a word of Latin ones, right in a word of their own.
_SCRIPT = re.compile(r"[Ͱ-ԯ]")
_SCRIPT_WORD = re.compile(r"[Ͱ-ԯ]{2}")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]")
#: Letters that no word of the five languages holds, but those of other Latin alphabets do.
_OTHER = re.compile(r"[ŽžŠšÐðÝýÞþŁłŚśŤťŘřĂăĄąĆćČčĎďĘęĚěĹĺĽľŃńŇňŐőŔŕŞşŢţŮůŰűŹźŻżŸ]")
#: Signs that stand in no word.
_SIGN = re.compile(r"[─-■√∞≠≤≥∂∑∏π∫◊ƒˆˇ˘˙˛˝¬¸]")
#: Marks that say nothing by their place.
SAFE = frozenset("°§ªº«»€£   ")

_LOW, _UP = "a-zàâäáãåæçéèêëíìîïñóòôöõœúùûüß", "A-ZÀÂÄÁÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕŒÚÙÛÜ"
_WORD = rf"(?:[{_UP}]?[{_LOW}]+|[{_UP}]+|[A-Z][a-z]+[A-Z][{_LOW}]+|\d+)"
#: A word of the five languages with what may stand before, within and after it.
_PLAIN = re.compile(rf"[\"'(\[«‹“„‘‚¿¡*_#>|~£€$-]*{_WORD}(?:[’'‑–—/.,:&@_%€+·|()\"«»“”-]+{_WORD})*[\"')\]»›”“’‘.,;:!?…%€°ºª®™*_|~-]*")
#: What any garbled text holds: a character that clean text of the five languages lacks or rarely has, or a capital letter or
#: mark in a place where no clean word has it.  A text without either is clean and not looked at word by word.
_RARE = re.compile("[^\x00-\x7fàâäáãåæçéèêëíìîïñóòôöõœúùûüßÀÂÄÁÇÉÈÊËÍÎÏÑÓÔÖÚÙÛÜŒ€£°§ªº«»‹›“”„‘’–—…•·©®™¿¡\u00a0\u202f\u2009" + SYMBOLS + "]")
_PLACED = re.compile(
    r"[âïÀÂÄÁÇÉÈÊËÍÎÏÑÓÔÖÚÙÛÜŒ“”„–—…•·‹›¿¡©®™](?:"
    r"(?<=[âï])(?=[^\x00-\x7fàâäáãåæçéèêëíìîïñóòôöõœúùûüß’])|(?<=Â)(?=[^\x00-\x7f])|(?<=Ô)(?=Ç)"
    r"|(?<=[a-zß-ÿœ0-9][À-ÖØ-ÞŒ])|(?<=[A-ZÀ-Þ][À-ÖØ-ÞŒ])(?=[a-zß-ÿœ])|(?<=[ \n\t][ÂÄÁÇÊËÍÎÏÑÖÚÛÜŒ])(?![^\W\d_])"
    r"|(?<=[^\W\d_][“”„–—…•·‹›¿¡©®™])(?=[^\W\d_])|(?<=[a-zß-ÿœ][—¡¿])(?!\w)|(?<= …)(?= [^\W\d_]))"
)
#: Words and marks that stand alone in clean text.
_ALONE = frozenset("àÀèÈéóÓ–—…«»‹›•·’“”€°")
_MARKS = re.compile(r"[%€$°:;!?,.…»«›‹–—·)(|*-]+")
#: Signs between letters that only the wrong words beside them show to be wrong.
_WITHIN = re.compile(rf"[{_LOW}{_UP}][§ºª£\u00a0][{_LOW}]")
#: Signs at the wrong end of a word.
_AT_END = re.compile(rf"(?:^|[^\w])[³²¹ⁿ¸][{_LOW}]|[{_LOW}{_UP}][¡¿¨∙¸´](?!\w)")
#: Accents that stand for a letter of their own.
_ACCENTS = "ˆˇ˘˙˛˝¸"
_CLOSED = re.compile(r"\w[‘’](?!\w)")
_ENDS = ".,;:!?)»\"'”’…"


def _garble(text: str, written: str, read: str) -> str | None:
    """Text as it comes out of the wrong decoding; None if a byte has no character there."""
    try:
        data = text.encode(written)
    except UnicodeEncodeError:
        return None
    out = []
    for byte in data:
        try:
            out.append(bytes([byte]).decode(read))
        except UnicodeDecodeError:
            if read not in ("cp1252", "cp1250", "cp1251"):
                return None
            out.append(chr(byte))  # lenient readers keep the control character
    return "".join(out)


def sequences() -> dict[str, dict[str, list[tuple[str, str]]]]:
    """Garbled sequence -> clean character -> pairs, for every pair, and once more for a second wrong decoding of the first two."""
    table: dict[str, dict[str, list[tuple[str, str]]]] = {}
    for written, read in PAIRS:
        for char in CLEAN + (SYMBOLS + FURTHER if written == "utf-8" else ""):
            seq = _garble(char, written, read)
            if not seq or seq == char:
                continue
            table.setdefault(seq, {}).setdefault(char, []).append((written, read))
            if written == "utf-8" and read in ("cp1252", "latin-1") and char not in FURTHER:
                for second in ("cp1252", "latin-1"):
                    twice = _garble(seq, "utf-8", second)
                    if twice and twice != seq:
                        table.setdefault(twice, {}).setdefault(char, []).append((f"{written}*2", second))
    return table


class Repairer:
    """Finds garbled spans by one automaton over all sequences and replaces nothing else.

    A sequence of two or more characters whose clean text is known counts wherever it
    stands, unless it is also plausible clean text.  A single character counts by its word:
    a letter of another script or a sign among Latin letters, or a capital after a small
    letter, and only where one pair of encodings makes words of the five languages of the wrong
    words of its line.  The pair is chosen line by line, the rest of the document deciding
    between equals; words that are not wrong, and words that would not come out clean, stay
    byte for byte, so that lines in other languages and scripts are left alone.
    """

    def __init__(self):
        table = sequences()
        self.automaton = ahocorasick.Automaton()
        self.single: dict[tuple[str, str], dict[str, str]] = {}
        for seq, chars in table.items():
            for char, pairs in chars.items():
                for pair in pairs:
                    if len(seq) == 1:
                        self.single.setdefault(pair, {})[seq] = char
            if len(seq) > 1:
                rank = lambda c: (c not in CLEAN, CLEAN.find(c) if c in CLEAN else ord(c))
                self.automaton.add_word(seq, (seq, min(chars, key=rank)))
        self.automaton.add_word("Ã ", ("Ã ", "à"))  # the hard space of a garbled à was made a plain one
        self.automaton.make_automaton()
        self.pairs = sorted(self.single, key=lambda p: PRIOR.index(p) if p in PRIOR else len(PRIOR))
        self.maps = {pair: {ord(k): v for k, v in chars.items()} for pair, chars in self.single.items()}
        self.suspects = {seq for table in self.single.values() for seq in table}
        self.memory: dict[str, tuple] = {}

    # ---- sequences of several characters ----

    def spans(self, line: str) -> list[tuple[int, int, str]]:
        """(start, end, clean) of multi-character sequences, longest first, without overlap."""
        found = []
        end_of_last = -1
        hits = [(end - len(seq) + 1, end + 1, clean) for end, (seq, clean) in self.automaton.iter(line)]
        for start, end, clean in sorted(hits, key=lambda h: (h[0], -h[1])):
            if start < end_of_last or self._plausible(line, start, end, clean):
                continue
            found.append((start, end, clean))
            end_of_last = end
        return found

    @staticmethod
    def _plausible(line: str, start: int, end: int, clean: str) -> bool:
        """A sequence that clean text may hold: capital letters of an upper-case word, a letter before a closing mark, a
        stretch of another script, or lines of a drawn table."""
        seq = line[start:end]
        before, after = line[start - 1 : start], line[end : end + 1]
        if seq == "Ã ":
            return not (before.islower() or before in ("", " ")) or after.isalnum()
        if all("─" <= c <= "▟" for c in seq) and not (before.isalpha() or after.isalpha()):
            return not (seq[0] in "┬├┼─" and seq[1] in "║╗╝╣╚╔╩╦╠═╬")  # tables do not go from single to double lines
        if len(seq) == 2 and _SCRIPT.match(seq[0]):
            beside = [c for c in (before, after) if c.isalpha()]
            if clean in FURTHER or seq[1].isalpha() or not seq[1].strip():  # right in a word of this script
                if not any(_LATIN.match(c) for c in beside) or any(_SCRIPT.match(c) for c in beside):
                    return True
        if len(seq) > 2 or any(ord(c) > 0x2000 and c not in "–—…•’‘“”€™†‡‚„‹›" or 0x80 <= ord(c) < 0xA0 for c in seq):
            return False
        first, second = seq[0], seq[1]
        if first in "ÃÂÄÅÐÑÎÏ" and not second.isalpha():
            # a word in capitals may end in such a letter before a mark
            if clean in FURTHER and not (before.islower() or after.isalpha() or after in "ÐÑÄÅÎÏ"):
                return True
            return before.isupper() and (second in "’”»…" or second == "\u00a0" and after in "!?:;»")
        if first in "ÃÂ" and _OTHER.match(second):
            return False
        if first.isupper() and second.isupper():
            return before.isupper() or after.isupper() or not (before.islower() or after.islower())
        if first.islower() and not second.isalpha():  # é followed by a mark
            return True
        if clean in FURTHER and first.isalpha() and second.isalpha():
            return not (first in "ÐÑÅÄ" and after and after in "ÐÑÅÄ")
        return first.islower() and second.isalpha() and second.islower()

    def unspan(self, line: str) -> tuple[bool, str]:
        """Whether there are garbled sequences, and the line with them restored, also where text was decoded wrongly twice."""
        text, garbled = line, False
        for _ in range(3):
            spans = self.spans(text)
            if not spans:
                break
            garbled = True
            parts, at = [], 0
            for start, end, clean in spans:
                parts += [text[at:start], clean]
                at = end
            text = "".join(parts) + text[at:]
        return garbled, text

    # ---- single characters ----

    def _wrong(self, line: str, start: int, end: int) -> int:
        """How surely the word line[start:end] is wrong: 2 by the place of a character, 1 by letters that only other
        languages have, 0 not at all."""
        latin, sure = None, 0
        for m in _NON_ASCII.finditer(line, start, end):
            i, c = m.start(), m.group()
            if _HARD.match(c):
                return 2
            before, after = line[i - 1 : i] if i > start else "", line[i + 1 : i + 2] if i + 1 < end else ""
            if _SCRIPT.match(c):
                if latin is None:
                    latin = _LATIN.search(line, start, end) is not None
                if latin or not before and not after.isalpha() and not _SCRIPT_WORD.search(line):
                    return 2
                continue
            if _SIGN.match(c):
                if before.isalpha() or after.isalpha() or c in _ACCENTS and not before and not after:
                    return 2
                continue
            if _OTHER.match(c):
                if not before and not after:
                    return 2
                if c.isupper() and (before.islower() or before.isupper() and after.islower() and not before.isascii()):
                    return 2
                sure = 1
                continue
            if c not in self.suspects or c in SAFE:
                continue
            outer = line[i - 1 : i] if i else ""
            if c.isalpha():
                if c == "ÿ":
                    wrong = not after.isalpha()
                elif c.isupper():
                    inside = before.islower() and (after.islower() or not after.isalpha()) or before.isupper() and after.islower()
                    alone = outer == " " and not after.isalpha() and c not in "ÀÈÉÌÒÓÔÙ"
                    wrong = inside or alone or before.isdigit()
                else:
                    wrong = before.isdigit() or before.isupper() and after.isupper() and c != "ß"
            elif c == "…":  # a letter of its own between two words
                wrong = end - start == 1 and line[i - 2 : i - 1].isalpha() and line[i + 2 : i + 3].isalpha()
            else:
                inside = before.isalpha() and after.isalpha() and before.islower() == after.islower()
                wrong = inside and c not in "’‘-" or c in "‡†‰" and before.islower() or c == "‚" and (before.isalpha() or before in ("'", "’")) and after.isalpha() or c == "‚" and before.islower() or c in "‡†‰" and after.islower() or c == "—" and before.islower() and not after.isalnum()
            if wrong:
                return 2
        return sure

    def _decoded(self, token: str, pair: tuple[str, str]) -> str | None:
        """A word read by a pair if it comes out as a word of the five languages."""
        made = token.translate(self.maps[pair])
        if made == token:
            return None
        for part in (_HARD.sub("e", made) if _HARD.search(made) else made).split("\u00a0"):  # what is lost may have been any letter
            if part and not (_PLAIN.fullmatch(part) or part.rstrip(_ENDS) in _ALONE or _MARKS.fullmatch(part)):
                return None
        return made

    def _readings(self, token: str) -> tuple:
        """(pair, clean word, weight) of a wrong word, bounded in memory."""
        known = self.memory.get(token)
        if known is None:
            if len(self.memory) > 50_000:
                self.memory.clear()
            made = []
            for pair in self.pairs:
                clean = self._decoded(token, pair)
                if clean is not None:
                    changed = [b for a, b in zip(token, clean, strict=False) if a != b] or [clean]
                    made.append((pair, clean, sum(3 if b.islower() else 1 for b in changed)))
            known = self.memory[token] = tuple(made)
        return known

    def check(self, text: str) -> list[tuple[int, str, str]]:
        """(line number, garbled line, restored line) of the lines of a text with garbled characters."""
        if not (_RARE.search(text) or _PLACED.search(text)):
            return []
        kept, votes, words = [], Counter(), {}
        for number, line in enumerate(text.split("\n"), 1):
            if line.isascii():
                continue
            garbled, restored = self.unspan(line)
            wrong, hard = [], False
            if not restored.isascii():
                hard = _HARD.search(restored) is not None
                for m in _TOKEN.finditer(restored):
                    sure = self._wrong(restored, m.start(), m.end())
                    if sure:
                        token = m.group()
                        wrong.append((m.start(), m.end(), sure))
                        for pair, _, weight in self._readings(token):
                            votes[pair] += weight if sure == 2 else 0
                            if sure == 1 and token[0].islower():
                                words.setdefault(pair, set()).add(token)
                        if sure == 1 and token[0].islower():  # names may be of any language
                            words.setdefault(None, set()).add(token)
            kept.append((number, line, restored, garbled or hard, wrong))
        for pair, own in words.items():  # letters of other alphabets are evidence only where they come out clean again and again
            if pair is not None and len(own) >= LEAST_WORDS and len(own) >= LEAST_CLEANED * len(words[None]):
                votes[pair] += len(own)
        out = []
        whole = max(votes, key=lambda p: (votes[p], -self.pairs.index(p)), default=None)
        for number, line, restored, garbled, wrong in kept:
            pair = None
            if votes:
                pair = self._pair(restored, wrong, votes) if wrong else whole
            if pair is not None:
                made = self._replaced(restored, wrong, pair)
                garbled, restored = garbled or made != restored, made
            if garbled:
                out.append((number, line, restored))
        return out

    def _pair(self, line: str, wrong: list[tuple[int, int, int]], votes: Counter) -> tuple[str, str] | None:
        """The pair that makes most of the wrong words of a line clean."""
        counts: Counter = Counter()
        total = 0
        for start, end, sure in wrong:
            readings = self._readings(line[start:end])
            total += bool(readings) or sure == 1
            for pair, _, _ in readings:
                counts[pair] += 1
        best = max((p for p in counts if votes[p]), key=lambda p: (counts[p], votes[p], -self.pairs.index(p)), default=None)
        return best if best is not None and counts[best] >= LEAST_CLEANED * total else None

    def _replaced(self, line: str, wrong: list[tuple[int, int, int]], pair: tuple[str, str]) -> str:
        """The line with its wrong words, and lone letters and opening marks that the same pair explains, read by the pair."""
        places = {(start, end) for start, end, _ in wrong}
        parts, at = [], 0
        for m in _TOKEN.finditer(line):
            token = m.group()
            clean = self._decoded(token, pair) if (m.start(), m.end()) in places else self._beside(line, token, pair, bool(places))
            if clean is not None:
                parts += [line[at : m.start()], clean]
                at = m.end()
        return "".join(parts) + line[at:]

    def _beside(self, line: str, token: str, pair: tuple[str, str], own: bool) -> str | None:
        """A word that only the wrong ones beside it show to be wrong: one letter of another script, an
        opening mark that nothing closes, or, if the line has wrong words of its own, a final mark that is a letter."""
        bare = token.rstrip(_ENDS)
        if len(bare) == 1 and (_SCRIPT.match(bare) or _OTHER.match(bare) or bare in _ACCENTS or bare.isupper() and not bare.isascii() and bare not in "ÀÈÉÓ"):
            return self._decoded(token, pair)
        if bare[-1:] == "ÿ" or _WITHIN.search(token) or own and _AT_END.search(token):
            return self._decoded(token, pair)
        if own and token[-1] == "…" and token[-2:-1].islower() or token == "…" or token[0] == "‚" and token[1:2].islower() and not _CLOSED.search(line):
            return self._decoded(token, pair)
        return None


def repaired(text: str, repairer: Repairer) -> str:
    """The text with its garbled lines restored as far as possible, for operators that look at words."""
    if text.isascii():
        return text
    found = repairer.check(text)
    if not found:
        return text
    lines = text.split("\n")
    for number, _, restored in found:
        lines[number - 1] = restored
    return "\n".join(lines)


def garbled_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, garbled, restored): every line with wrongly decoded characters, with the original where it can be had.

    One narrow pass; the automaton is built once a task from the table of encodings.
    ``restored`` keeps what cannot be restored, such as U+FFFD.  Single wrong characters are
    told by words of the five languages; text in other languages and scripts stays as it is.
    Null and empty texts give no row, repeated rows give repeated rows, null ids are kept.
    """

    def make():
        repairer = Repairer()

        def one(key, text):
            if not text or text.isascii():
                return []
            return [(key, *found) for found in repairer.check(text)]

        return one

    fields = [("id", pa.int64()), ("line_no", pa.int32()), ("garbled", pa.string()), ("restored", pa.string())]
    rows = spread(columns(docs, id=id_col, text=text_col))
    return map_rows(rows, "id bigint, line_no int, garbled string, restored string", make, fields).withColumnRenamed("id", id_col)
