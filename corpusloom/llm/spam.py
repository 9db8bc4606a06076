"""Problem 10: keyword-stuffed and link-list pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import columns, map_rows, spread
from corpusloom.llm.mojibake import Repairer, repaired
from corpusloom.llm.page import FILLER, LIST, MESSAGE, TABLE, TITLE, Classifier, Page
from corpusloom.llm.lexicon import has_latin
from corpusloom.llm.residue import has_placeholder, is_latin_filler

#: Fixed function words of the five languages; a list of nouns has none of them.
_FUNCTION = """
    le la les de des du et à en un une que qui dans pour pas sur plus par avec est sont ce cette il au aux ou se ne nous vous mais sans selon même
    dont où été depuis l d qu s n c
    der die das und in zu den ein eine einen nicht von mit ist im für auf dem sich auch es an als wie bei aus nach was wird sind aber ohne über durch
    noch dass wenn oder ab gegen damit
    il di che e non con del della le gli i da al dei si come più ma anche nel alla ha lo questo questa senza dopo perché dove se o su ci dal
    el los las por para su como pero sin este esta son ya sus desde porque donde según entre también aunque muy y
    the of and to a that for it on with as are this by be at from or an which but have has was were will can you your we our their than more so if
    because
    """

_WORD = re.compile(r"[a-z]+")
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_DOT = re.compile(r"\.(?<=\w\.)[^\W\d_]|://")  # a literal first, which is found fastest
_CAMEL = re.compile(r"(?<=[^\W\d_A-ZÀ-Þ])(?=[A-ZÀ-Þ])")
_TARGET = re.compile(r"\(?\bhttps?://\S+|\bwww\.\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|test|com|org|net|info|shop|biz|de|fr|it|es|co\.uk)\b\S*")
_SHORT_ENTRY = re.compile(r"^\S+(?: \S+){0,3} ?[,:] \S+(?: \S+){0,3}$")
_WIDE, _YEAR_END = re.compile(r"\s{3,}"), re.compile(r"\(\d{4}\)$")
_HASHTAG = re.compile(r"(?:^|\s)#[^\W\d_]{3}\w*(?=[\s,.;!]|$)")

#: Words are compared without letters outside ASCII, so that wrong decodings stay words.
FUNCTION_WORDS = frozenset(filter(None, (_NON_ASCII.sub("", w) for w in _FUNCTION.split())))

#: Lag, in words, within which a recurrence is near; regularity is judged over all lags.
FAR = 60

#: Shares and weights of :func:`is_spam`.
STUFFED, LINKS, TAGS = 0.13, 0.5, 0.4

#: Repetition is unnaturally regular if so large a part of the recurrences of content words is at one lag, and so large
#: a part of them recurs: about two and a half rounds of a cycle, or fewer in text without function words. Below
#: MIN_CONTENT content words, chance alone makes a lag stand out.
REGULAR, CYCLES, LISTED_CYCLES, MIN_CONTENT = 0.6, 0.6, 0.4, 20

#: A list of nouns in one line has so many items, or so many words where only spaces part them; a part of them is readable.
NOUN_ITEMS, NOUN_WORDS, NOUN_READABLE = 6, 11, 0.7

_ITEMS = re.compile(r"\s*[|;/·•‣»›\t]\s*|\s{2,}|\s[–-]\s")


def words_of(lines: list[str]) -> list[str]:
    """Lower-cased words without link targets; joined words of tags are split at capitals."""
    text = "\n".join(lines)
    if _DOT.search(text):
        text = _TARGET.sub(" ", text)
    if "#" in text:
        text = "\n".join(_CAMEL.sub(" ", x) if _HASHTAG.search(x) else x for x in text.split("\n"))
    return _WORD.findall(_NON_ASCII.sub("", text).lower())


def dominant_lag(lags: Counter) -> tuple[int, int]:
    """Lag at which most recurrences stand, within a sixteenth of it to both sides, and their number."""
    keys = sorted(lags)
    best, start, held = (0, 0), 0, 0
    for key in keys:
        held += lags[key]
        while key - keys[start] > max(2, keys[start] // 8):
            held -= lags[keys[start]]
            start += 1
        if held > best[1]:
            best = (keys[start] + key) // 2, held
    return best


def recurrence(words: list[str]) -> tuple[float, float, float, float, float, int]:
    """Recurrence of terms by gap: shares of positions whose content word, and whose pair of content
    words, last stood at most FAR words before; the share of the recurrences of content words, at whatever
    distance, that stand at the dominant lag; the share of function words; the share of content words that
    recur at all; the dominant lag.

    The gaps are a positional autocorrelation: the count at one lag over all positions is
    the chance that a word stands again at that distance.  Prose repeats a word at
    irregular distances; stuffed text at short ones, or in one place of the spectrum,
    which may lie as far out as the text is long.
    """
    n = len(words)
    if n < 2:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0
    seen: dict = {}
    pairs: dict = {}
    lags: Counter = Counter()
    single = double = function = 0
    previous = None
    for i, word in enumerate(words):
        if word in FUNCTION_WORDS:
            function += 1
            previous = None
            continue
        if word in seen:
            gap = i - seen[word]
            lags[gap] += 1
            single += gap <= FAR
        seen[word] = i
        if previous is not None:
            pair = (previous, word)
            double += i - pairs.get(pair, -FAR - 1) <= FAR
            pairs[pair] = i
        previous = word
    lag, at_lag = dominant_lag(lags)
    recurring = sum(lags.values())
    return single / n, double / n, at_lag / max(1, recurring), function / n, recurring / max(1, n - function), lag


def is_varied(words: list[str]) -> bool:
    """Surely no stuffed text: function words are there, and pairs of words rarely recur in any stretch of it."""
    if sum(map(FUNCTION_WORDS.__contains__, words)) < 0.14 * len(words):
        return False
    for start in range(0, len(words), 400):
        part = words[start : start + 400]
        if len(part) >= 60 and len(set(zip(part, part[1:], strict=False))) < (1 - STUFFED) * (len(part) - 1):
            return False
    if len(words) > 400 and len(set(zip(words, words[1:], strict=False))) * 2 < len(words):  # a cycle longer than a stretch
        return False
    return len(words) >= 60


def is_noun_list(line: str, readable: Callable[[str], bool] | None = None) -> bool:
    """A line of many short items without function words and numbers, parted by bars, points, semicolons, slashes, gaps or spaces.

    Rows of Markdown tables are none.  What only spaces part is a list only if ``readable``
    is given and knows most of the words; otherwise it may be text without words.
    """
    if line[0] in "|#" or line[-1] in ".!?" or any(map(str.isdigit, line)):
        return False
    items = [x for x in _ITEMS.split(line) if x]
    words = line.lower().split() if len(items) == 1 else [w for x in items for w in x.lower().split()]
    if len(items) >= NOUN_ITEMS:
        if sum(x.count(" ") <= 2 for x in items) * 10 < 9 * len(items):
            return False
    elif len(items) > 1 or readable is None or len(words) < NOUN_WORDS or "," in line or ":" in line:
        return False
    if sum(_NON_ASCII.sub("", w) in FUNCTION_WORDS for w in words) * 25 > len(words):
        return False
    return readable is None or sum(map(readable, words)) >= NOUN_READABLE * len(words)


def is_entry(line: str) -> bool:
    """A line in the shape of an entry of a list or of a row: two short parts, cells, or a year at its end."""
    if "   " in line or "\t" in line or line.count(";") > 1:
        return True
    if line[-1] == ")" and _YEAR_END.search(line) or line.count(" ") <= 8 and _SHORT_ENTRY.match(line):
        return True
    return not line.isascii() and _WIDE.search(line) is not None


def is_grid(lines: list[str]) -> bool:
    """At least three lines of one number of items are the rows of a table."""
    sizes = {len(_ITEMS.split(x)) for x in lines}
    return len(lines) >= 3 and len(sizes) == 1 and sizes != {1}


def is_spam(page: Page, readable: Callable[[str], bool] | None = None) -> bool:
    """Main body of repeated keywords, links or tags, of words in an unnaturally regular cycle of whatever length, or a run
    of distinct nouns without function words that is no list or table; ``readable`` tells words from other letters."""
    at = page.body()
    body = [page.lines[i] for i in at if page.kinds[i] not in (TABLE, FILLER, MESSAGE)]
    low = "\n".join(body).lower()
    if has_latin(low):
        body = [x for x in body if not is_latin_filler(x)]
    body = [x for x in body if not has_placeholder(x)]
    listed = [page.lines[i] for i in at if page.kinds[i] not in (FILLER, MESSAGE) and len(page.lines[i]) > 40]
    nouns = [x for x in listed if is_noun_list(x, readable)]
    if nouns and len(nouns) * 2 >= len(at) and not is_grid(nouns):
        return True
    if not body:
        return False
    if _DOT.search("\n".join(body)):
        links = sum(bool(_TARGET.search(x)) for x in body)
        if links >= 3 and links >= LINKS * len(at):
            return True
    if sum(len(_HASHTAG.findall(x)) >= 3 for x in body if "#" in x) >= TAGS * len(at):
        return True
    words = words_of(body)
    if len(words) < 12 or is_varied(words):
        return False
    single, double, regular, function, recurring, lag = recurrence(words)
    cyclic = regular >= REGULAR and len(words) * (1 - function) >= MIN_CONTENT
    structured = sum(page.kinds[i] in (LIST, TABLE, TITLE) or is_entry(page.lines[i]) for i in at)
    if structured * 2 >= len(at):  # entries of lists repeat their heads; only dense repetition and cycles longer than entries count
        return double >= 2 * STUFFED or cyclic and recurring >= CYCLES and lag > FAR
    if cyclic and recurring >= (CYCLES if function >= 0.14 else LISTED_CYCLES):
        return True
    if (double >= STUFFED or single >= 0.42 and function < 0.14) and sum(map(len, words)) >= 3 * len(words):
        return True
    nouns = [x for x in body if x.count(",") >= 5 and x.count(",") * 5 >= len(x.split())]
    return function < 0.04 and len(nouns) * 2 >= len(at)


def spam_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "title", sample: Iterable[str] = ()
) -> DataFrame:
    """(id): documents whose text is spam.

    Each page is judged on its own in one narrow pass, from the gaps at which its terms
    recur.  ``sample`` is a bounded sample of clean text and words that tells readable
    words; without it lists of nouns parted by spaces alone are not told from text without words.  Null, empty and very short texts are no spam; repeated rows give one row,
    which is the only shuffle, of ids of cases; null ids are left out.
    """

    from corpusloom.llm.quality import Readable  # quality reads this module

    texts = list(sample)

    def make():
        kind_of, repairer, readable = Classifier(), Repairer(), Readable(texts) if texts else None

        def one(key, text, title):
            return [(key,)] if key is not None and text and is_spam(Page(repaired(text, repairer), title, kind_of), readable) else []

        return one

    rows = spread(columns(docs, id=id_col, text=text_col, title=title_col))
    return map_rows(rows, "id bigint", make, [("id", pa.int64())]).distinct().withColumnRenamed("id", id_col)
