"""Garbled text from a wrong character encoding.

Characters are mapped back to the bytes of a legacy encoding, and an automaton over the structure of these bytes (a regular
expression whose classes are the characters of each byte range) finds the maximal well-formed multibyte spans; only these spans
are decoded. This is done for UTF-8 read as a one-byte code page or as GBK or Shift-JIS, again and again where text was garbled
twice, and for GBK, Shift-JIS and EUC-KR read as Western text. Where the damage has no multibyte structure, it is still found:
one-byte Cyrillic read in another code page by its letter frequencies, and remains that cannot be decoded (replacement
characters, C1 controls, lead bytes whose continuation was lost or whose case was changed).

``by`` tells which way found a text: "spans" (the automata, also those over the bytes of East Asian runs), "letters" (frequencies, signs inside words) or "remains".

Defined cases: null and ASCII texts without character references are clean; an empty text is clean; text between backticks on one line, of any length,
quotes characters and is not judged; ``restored`` is the text with every decodable span decoded, as often as it was garbled, null if none was; texts are processed whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One-byte code pages in which UTF-8 is often misread; "western" is Windows-1252 with Latin-1 for its gaps.
PAGES = ("western", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp1254", "cp1253", "cp866", "koi8_r", "iso8859_2")
#: Relative frequency (in thousandths) of the letters of Russian text.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1)))
SHORT = frozenset("и в с к о у а я на по не до от из за но об ко со во же бы ли".split())
CYRILLIC_PAGES = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")

_QUOTED = re.compile(r"`[^`\n]+`")
_REFS = re.compile(r"(?:&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)+")


@cache
def byte_of(page: str) -> dict[str, int]:
    """Character -> byte, of the upper half of a code page; undefined bytes count as C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode("cp1252" if page == "western" else page)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
        if page == "western":
            out.setdefault(chr(b), b)
    return out


@cache
def utf8_spans(page: str) -> re.Pattern:
    """The automaton: maximal runs of well-formed multibyte UTF-8 in the characters of a code page."""
    chars = byte_of(page)

    def cls(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in chars.items() if lo <= b <= hi) + "]"

    tail = cls(0x80, 0xBF)
    forms = [
        cls(0xC2, 0xDF) + tail,
        cls(0xE0, 0xE0) + cls(0xA0, 0xBF) + tail,
        cls(0xE1, 0xEC) + tail * 2,
        cls(0xED, 0xED) + cls(0x80, 0x9F) + tail,
        cls(0xEE, 0xEF) + tail * 2,
        cls(0xF0, 0xF0) + cls(0x90, 0xBF) + tail * 2,
        cls(0xF1, 0xF3) + tail * 3,
        cls(0xF4, 0xF4) + cls(0x80, 0x8F) + tail * 2,
    ]
    return re.compile("(?:" + "|".join(forms) + ")+")


#: Characters that texts are made of, as what a span may decode to: signs and letters of Western and Central Europe; the other scripts.
_SIGNS_OUT = r"ˆ˜ -⁯₠-₿℀-⅏←-⏿─-➿⬀-⯿️﻿\U0001F300-\U0001FAFF"
_WESTERN_OUT = re.compile(r"[\x80-ſƒȘ-ț" + _SIGNS_OUT + r"]*\Z")
_OTHER_OUT = re.compile(r"[\x00-ſƒȘ-țΆ-ώЁ-џҐґ　-ヿ一-鿿가-힯＀-￯" + _SIGNS_OUT + r"]*\Z")
_BOX = re.compile(r"[─-□]+\Z")
_ONE_SCRIPT = re.compile(r"(?:[Ё-џҐґ\u2010-\u2026№«»]{2,}|[\u0386-\u03ce]{3,}|[\u3000-\u30ff\u4e00-\u9fff\uff01-\uff5e]{3,}|[\uac00-\ud7af]{3,})\Z")


def _decode_span(span: str, before: str, after: str, page: str, sure: bool) -> str | None:
    """What a span between two characters decodes to, or None if it is sound text that only looks like bytes. ``sure``: other spans of the text were garbled under the same page."""
    cyrillic = page in ("cp1251", "cp866", "koi8_r")
    if cyrillic and ("\u0400" <= before <= "\u045f" or "\u0400" <= after <= "\u045f"):
        return None  # part of a sound word
    chars = byte_of(page)
    out = bytes([chars[c] for c in span]).decode("utf-8")
    western = _WESTERN_OUT.match(out)
    if not western and not (len(out) >= (1 if sure else 2) and _OTHER_OUT.match(out)):
        return None
    if page != "western" and any("\x80" <= c <= "\x9f" for c in out):
        return None
    drawn = _BOX.match(before) or _BOX.match(after)
    if _BOX.match(span) and not (sure and (western or out.isalpha()) and not drawn) and not (out.isalpha() and (before.isalpha() and before.isascii() or after.isalpha() and after.isascii())):
        return None  # a drawing
    if cyrillic and not western and not (_ONE_SCRIPT.match(out) or sure and out.isalpha()):
        return None
    return out


_decode_short = lru_cache(1 << 16)(_decode_span)


@cache
def _pair(page: str) -> tuple[frozenset[str], frozenset[str], re.Pattern]:
    """Lead bytes and continuation bytes in the characters of a code page, and one after the other: what every span begins with."""
    lead, tail = (frozenset(c for c, b in byte_of(page).items() if lo <= b <= hi) for lo, hi in ((0xC2, 0xF4), (0x80, 0xBF)))
    cls = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
    return lead, tail, re.compile(cls(lead) + cls(tail))


def _may_hold(page: str, odd: set[str], dense: str) -> bool:
    """Whether ``dense``, whose characters are ``odd``, holds a lead byte followed by a continuation byte."""
    lead, tail, pair = _pair(page)
    return not (lead.isdisjoint(odd) or tail.isdisjoint(odd)) and pair.search(dense) is not None


def _undo_utf8(text: str, page: str) -> tuple[str, int]:
    """The text with its spans decoded, and the number of characters decoded."""
    hits = 0

    sure = False

    def put(m: re.Match) -> str:
        nonlocal hits
        a, b = m.span()
        out = (_decode_short if b - a <= 16 else _decode_span)(m[0], text[a - 1 : a], text[b : b + 1], page, sure)
        if out is None:
            return m[0]
        hits += len(out)
        return out

    spans = utf8_spans(page)
    got = spans.sub(put, text)
    if hits >= 3 and got != text:
        sure, hits = True, 0
        got = spans.sub(put, text)
    return got, hits


# --- UTF-8 read as an East Asian encoding: the bytes of whole runs of ideographs

_EAST_RUN = re.compile(r"(?:[⺀-鿿가-힯豈-﫿-︰-﹯！-￯‐-※€℀-⌒①-♯　-㏿Α-ёĀ-ǜ\xa7\xa8\xb0\xb1\xb7\xd7\xf7\xe0-\xfcˇˉ]){2,}")
_UTF8_BYTES = re.compile(rb"(?:[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|[\xc2-\xdf][\x80-\xbf]){2,}")


_THREE_BYTES = re.compile(rb"[\xe1-\xef][\x80-\xbf]{2}")


def _undo_east(text: str, runs: set[str], codec: str) -> tuple[str, int]:
    """``runs``: the runs of East Asian characters of the text."""
    done = {}
    for run in runs:
        raw = run.encode(codec, "ignore")
        if len(raw) < 6 or 3 * len(_THREE_BYTES.findall(raw)) < 0.7 * len(raw) or sum(len(x) for x in _UTF8_BYTES.findall(raw)) < 0.8 * len(raw):
            continue
        out = raw.decode("utf-8", "replace")
        if _OTHER_OUT.match(out.replace("�", "")):
            done[run] = out
    if not done:
        return text, 0
    hits = 0

    def put(m: re.Match) -> str:
        nonlocal hits
        out = done.get(m[0])
        if out is None:
            return m[0]
        hits += len(out) - out.count("�")
        return out

    return _EAST_RUN.sub(put, text), hits


# --- East Asian encodings read as Western text


@cache
def _western_class(lo: int, hi: int) -> str:
    return "".join(re.escape(c) for c, b in byte_of("western").items() if lo <= b <= hi)


@cache
def east_spans(codec: str) -> re.Pattern:
    """Maximal runs of at least three two-byte characters in the structure of the encoding."""
    w = _western_class
    if codec == "cp932":
        one = rf"(?:[{w(0x81, 0x9F)}{w(0xE0, 0xFC)}](?:[{w(0x80, 0xFC)}]|[@-~])|[{w(0xA1, 0xDF)}])"
    elif codec == "gbk":
        one = rf"[{w(0x81, 0xFE)}](?:[{w(0x80, 0xFE)}]|[@-~])"
    else:
        one = rf"[{w(0xA1, 0xFE)}][{w(0xA1, 0xFE)}]"
    return re.compile(rf"{one}{{3,}}")


_SEVERAL = re.compile(r"[^\x00-\x7f]{5,}")


def _common(out: str, codec: str) -> float:
    """Share of characters that are usual in texts of the encoding."""
    usual = 0
    for c in out:
        if c in "、。，：；！？（）「」『』ー・" or "぀" <= c <= "ヿ":
            usual += codec in ("cp932", "euc_jp") or c in "、。，：；！？（）"
        elif "가" <= c <= "힯":
            usual += codec == "euc_kr"
        elif "一" <= c <= "鿿":
            try:
                usual += 0xB0 <= c.encode("gb2312")[0] <= 0xD7 if codec == "gbk" else 0x88 <= c.encode("cp932")[0] <= 0x97 if codec in ("cp932", "euc_jp") else 0
            except UnicodeEncodeError:
                pass
        elif "\u2500" <= c <= "\u257f":
            usual += 1
        elif c.isascii():
            usual += 0.5
    return usual / max(len(out), 1)


def _level_one(c: str, codec: str, lo: int, hi: int) -> bool:
    try:
        return lo <= c.encode(codec)[0] <= hi
    except UnicodeEncodeError:
        return False


@lru_cache(1 << 16)
def _levels(c: str) -> tuple[bool, bool, bool]:
    """Whether a character is a usual one of simplified, traditional or Japanese text."""
    return _level_one(c, "gb2312", 0xB0, 0xD7), _level_one(c, "big5", 0xA4, 0xC6), _level_one(c, "cp932", 0x88, 0x97)


def _sound_east(run: str) -> float:
    """Largest share of usual characters the run has as simplified, traditional, Japanese or Korean text."""
    plain = sum(c in "，。、：；！？「」（）《》“”‘’—…％" for c in run)
    levels = [_levels(c) for c in run]
    shares = [
        sum(x[0] for x in levels),
        sum(x[1] for x in levels),
        sum("\u3041" <= c <= "\u30ff" for c in run) * 2 + sum(x[2] for x in levels) if any("\u3041" <= c <= "\u3096" for c in run) else 0,
        sum("\uac00" <= c <= "\ud7af" for c in run),
    ]
    return min(1.0, (max(shares) + plain) / len(run))


#: East Asian encodings taken for one another (read as, written in).
EAST_PAIRS = (("big5", "gbk"), ("gbk", "big5"), ("cp932", "gbk"), ("gbk", "cp932"), ("euc_kr", "gbk"), ("gbk", "euc_kr"), ("cp932", "euc_jp"), ("euc_jp", "cp932"), ("big5", "cp932"), ("cp932", "big5"))


_SENTENCE = re.compile(r"(?:[⺀-⿟々-鿿가-힯豈-﫿︰-﹜﹞-﹯＂-＋－-＞＠-￯‐-※]){2,}[　-。﹝，！？]?")


def _undo_east_pair(text: str) -> tuple[str, int]:
    """Text of one East Asian encoding read as another: usual characters became rare ones."""
    runs = [r for r in _SENTENCE.findall(text) if len(r) >= 5 and sum("\u3041" <= c <= "\ud7af" for c in r) > len(r) // 2]
    bad = [r for r in runs if _sound_east(r) < 0.8]
    if sum(map(len, bad)) < 8:
        return text, 0
    best = (text, 0, 0.0)
    for wrong, right in EAST_PAIRS:
        done = {r: r.encode(wrong, "ignore").decode(right, "replace") for r in bad}
        share = sum(_sound_east(x) * len(x) for x in done.values() if x) / max(1, sum(map(len, done.values())))
        if share > 0.88 and share > best[2]:
            best = (_SENTENCE.sub(lambda m: done.get(m[0], m[0]), text), sum(map(len, bad)), share)
    return best[0], best[1]


def _undo_western_east(text: str) -> tuple[str, int]:
    best = (text, 0, 0.0)
    for codec in ("cp932", "euc_jp", "gbk", "euc_kr"):
        hits, weight = 0, 0.0

        def put(m: re.Match) -> str:
            nonlocal hits, weight
            if not _SEVERAL.search(m[0]):
                return m[0]
            chars = byte_of("western")
            raw = bytes(chars[c] if c in chars else ord(c) for c in m[0])
            out = raw.decode(codec, "replace")
            share = _common(out, codec)
            if share < 0.7 or "�" in out[:-1]:
                return m[0]
            hits += len(out)
            weight += share * len(out) * (1.2 if codec in ("cp932", "euc_jp") and any("ぁ" <= c <= "ん" for c in out) else 1)
            return out

        got = east_spans(codec).sub(put, text)
        if weight > best[2]:
            best = (got, hits, weight)
    return best[0], best[1]


# --- Cyrillic of one code page read in another: no structure, but letter frequencies

_WORDISH = {
    "western": re.compile(r"[À-ÿ¸¨\x80-\x9f€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{3,}"),
    "cyrillic": re.compile(r"[Ё-џҐґ─-▟√\xa0\x80-\x9f\xa4\xa6-\xa9\xab-\xae\xb0\xb1\xb5-\xb7\xbb‘-„†-•…‰‹›€№™■∙]{3,}"),
}


@lru_cache(1 << 16)
def _weight(word: str) -> int:
    upper = word.isupper()
    return sum(RUSSIAN.get(c.lower(), 0) for i, c in enumerate(word) if not i or upper or not c.isupper())


def _russian(words: list[str]) -> float:
    """Mean frequency of the letters of words in thousandths; odd capitals and signs count nothing."""
    return sum(map(_weight, words)) / max(1, sum(map(len, words)))


def _reread(text: str, pattern: re.Pattern, better: set[str], chars: dict[str, int], right: str) -> str:
    """Re-reads the stretches around the words of ``better``, up to the next word that is sound as it stands."""
    runs = list(re.finditer(pattern.pattern.replace("{3,}", "+"), text))

    def read(w: str) -> str | None:
        return bytes(chars[c] for c in w).decode(right, "replace") if all(c in chars for c in w) else None

    def plain(w: str | None) -> bool:
        return w is not None and (w.islower() or w.istitle()) and all(c.lower() in RUSSIAN for c in w)

    mine = [m[0] in better for m in runs]
    sound = [not mine[i] and (not plain(read(m[0])) or m[0].lower() in SHORT or (len(m[0]) > 2 and plain(m[0]) and _russian([m[0]]) >= 38)) for i, m in enumerate(runs)]
    for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
        step = 1 if order.step > 0 else -1
        for i in order:
            mine[i] = mine[i] or (mine[i - step] and not sound[i])
    out, at = [], 0
    for m, take in zip(runs, mine):
        w = read(m[0]) if take else None
        if w is not None and "�" not in w:
            out += [text[at : m.start()], w]
            at = m.end()
    return "".join([*out, text[at:]])


def _undo_cyrillic(text: str) -> tuple[str, int]:
    """Re-reads the words that become Russian by it; at least two words and twelve letters."""
    best = (text, 0, 0.0)
    for kind, pattern in _WORDISH.items():
        words = [w for w in pattern.findall(text) if (len(w) >= 4 if kind == "western" else any("\u0400" <= c <= "\u045f" for c in w))]
        if len(words) < 2:
            continue
        before = {w: _russian([w]) for w in set(words)}
        words = [w for w in words if before[w] < 42]
        if len(words) < 2 or sum(map(len, words)) < 12:
            continue
        for wrong in ("western",) if kind == "western" else CYRILLIC_PAGES:
            chars = byte_of(wrong)
            fit = [w for w in words if all(c in chars for c in w)]
            for right in CYRILLIC_PAGES:
                if right == wrong or not fit:
                    continue
                done = {w: bytes(chars[c] for c in w).decode(right, "replace") for w in set(fit)}
                better = [w for w in fit if _russian([done[w]]) > before[w] + 15 and all(c.lower() in RUSSIAN for c in done[w])]
                size = sum(map(len, better))
                if len(better) < 2 or size < 12:
                    continue
                was, now = _russian(better), _russian([done[w] for w in better])
                if now > 46 and was < 30 and size * (now - was) > best[2]:
                    best = (_reread(text, pattern, set(better), chars, right), size, size * (now - was))
    return best[0], best[1]


# --- one-byte Western or Central European text read in another page: letters that stand in the middle of Latin words

#: Letters of Polish, Czech, Slovak and Hungarian beyond ASCII.
CENTRAL = frozenset("ąćęłńóśźżáčďéěíňřšťúůýžäĺľôŕöőüű")
_SIGN_IN_WORD = re.compile("(?<=[A-Za-z])[\xb9\xb3\xbf\xb1\xb6\xbc]+(?=[a-z\xe0-\xff])")
_SIGN_ENDS = re.compile("(?<=[a-z]{3})[\xb9\xb3\xbf\xb1\xb6\xbc](?=[ ,.\n]|\\Z)|(?:\\A|(?<=[ \n]))[\xb3\xbf\xb6\xbc\xa6\xa3][a-z]{2}")
_CENTRAL_WORD = re.compile(r"[A-Za-z\x80-\x9f\xa1-\xffŒœŸŽžŠš]+")


_SIGNS = frozenset("\xb9\xb3\xbf\xb1\xb6\xbc")


def _undo_central(text: str, odd: set[str]) -> tuple[str, int]:
    """Central European text read as Western: signs such as the superscripts stand in the middle of words. ``odd``: the characters of the text beyond ASCII."""
    if _SIGNS.isdisjoint(odd) or not _SIGN_IN_WORD.search(text):
        return text, 0
    inside = len(_SIGN_IN_WORD.findall(text))
    least = 1 if inside + len(_SIGN_ENDS.findall(text)) > 1 else 3
    best = (text, 0)
    for right in ("cp1250", "iso8859_2"):
        chars, hits = byte_of("western"), 0

        def put(m: re.Match) -> str:
            nonlocal hits
            if m[0].isascii():
                return m[0]
            out = bytes(chars.get(c) or ord(c) for c in m[0]).decode(right, "replace")
            if all(c.isascii() or c.lower() in CENTRAL for c in out):
                hits += sum(not c.isascii() for c in out)
                return out
            return m[0]

        got = _CENTRAL_WORD.sub(put, text)
        if hits > best[1] and hits >= least:
            best = (got, hits)
    return best


_LEFT = re.compile(
    "�|[\x80-\x84\x86-\x9f]|\xef\xbb\xbf"  # cannot stand in any text
    "|\xe2{2,}(?=[ \n]|\\Z)|(?:\xe2 ){2,}"  # drawings whose continuation bytes were lost
    "|[\xe3\xe2][\xa1-\xa9\xab\xac\xae\xaf\xb1\xb4-\xb8\xbc-\xbf€]"  # a lead byte in lower case
    "|(?<=[a-z])\xe2(?=(?:t|s|re|ve|ll|d|m)\\b)|(?<= )\xe2(?= )"  # an apostrophe or a dash, likewise
    "|(?<=[ \n])\xc3(?= )|(?<=[0-9.,;:!?])\xc2(?= )"  # a no-break space that became a plain one
    "|\\b\xc3(?=[a-z]{2})|(?<=[a-z])\xc3(?=[a-z ,.])"  # a capital letter whose second byte was lost
)
#: What every match of the pattern above has in it.
_LEFT_CHARS = frozenset("�\xef\xe2\xe3\xc3\xc2") | {chr(c) for c in range(0x80, 0xA0)}
_LOWER_LEADS = frozenset("\xe3\xe2\xe4\xe5")
_LOWER = re.compile("[\xe3\xe2\xe4\xe5][\xa1-\xac\xae-\xba\xbc-\xbfƒ†‡ˆ‰ŠŒŽ˜™šœžŸ€][\xa1-\xbf‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€]*")


_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
#: Cyrillic, drawings, or four letters beyond ASCII in a row.
_SUSPECT = re.compile("[\u0400-\u045f]{2}|[\u2500-\u259f][\u0400-\u045f]|[\xa8\xb8\xc0-\xff]{4}")


@cache
def _western_run() -> re.Pattern:
    """Five characters of the Western page beyond ASCII in a row."""
    return re.compile("[" + "".join(map(re.escape, byte_of("western"))) + "]{5}")


def _lift(m: re.Match) -> str:
    return m[0][0].upper() + m[0][1:]


def _references(text: str) -> str:
    """Runs of character references that stand for garbled text become characters; other references stay."""
    if "&" not in text:
        return text
    runs = {m[0]: html.unescape(m[0]) for m in _REFS.finditer(text)}
    bad = {r for r, chars in runs.items() if _undo_utf8(chars, "western")[1] or _LEFT.search(chars)}
    if bad:
        bad |= {r for r, chars in runs.items() if utf8_spans("western").fullmatch(chars)}
    return _REFS.sub(lambda m: runs[m[0]] if m[0] in bad else m[0], text)


def _beyond(text: str) -> set[str]:
    return {c for c in set(text) if c > "\x7f"}


def _one_round(now: str, odd: set[str]) -> tuple[str, str] | None:
    """(the text with one layer of damage undone, by which way), or None. ``odd``: the characters of the text beyond ASCII."""
    tries: list[tuple[int, int, str]] = []
    by = "spans"
    runs = set(_RUNS.findall(now)) if odd else ()
    if runs:
        dense = "\x00".join(runs)  # a span has no ASCII in it
        tries += [(hits, -i, got) for i, page in enumerate(PAGES) if _may_hold(page, odd, dense) for got, hits in [_undo_utf8(now, page)] if hits]
        east = any("\u2e80" <= c <= "\uffef" for c in odd)
        if east:
            found = set(_EAST_RUN.findall(now))
            tries += [(hits, -20, got) for codec in ("gb18030", "cp932") for got, hits in [_undo_east(now, found, codec)] if hits >= 2]
        if _western_run().search(dense):
            got, hits = _undo_western_east(now)
            if hits >= 3:
                tries.append((hits, -30, got))
        if not tries and east:
            by = "letters"
            got, hits = _undo_east_pair(now)
            if hits:
                tries.append((hits, -40, got))
        if not tries and _SUSPECT.search(dense):
            by = "letters"
            got, hits = _undo_cyrillic(now)
            if hits:
                tries.append((hits, -40, got))
    if not tries:
        by = "letters"
        got, hits = _undo_central(now, odd)
        if hits:
            tries.append((hits, -40, got))
    if not tries and not _LOWER_LEADS.isdisjoint(odd) and len(_LOWER.findall(now)) > 1:
        by = "remains"
        got, hits = _undo_utf8(_LOWER.sub(_lift, now), "western")
        if hits:
            tries.append((hits, -50, got))
    return (max(tries)[2], by) if tries else None


def judged(text: str) -> tuple[str | None, str | None]:
    """(how the text was found to be garbled or None, the restored text or None)."""
    if text.isascii() and "&" not in text:
        return None, None
    quoted: list[str] = []

    def hide(m: re.Match) -> str:
        if m[0].isascii():
            return m[0]
        quoted.append(m[0])
        return f"\x00{len(quoted) - 1}\x00"

    bare = _QUOTED.sub(hide, text) if "`" in text else text
    now = _references(bare)
    by = "spans" if now != bare else None
    before = {now}
    while True:  # as often as it was garbled; spans grow shorter every time, and no text comes twice
        odd = _beyond(now)
        undone = _one_round(now, odd)
        if undone is None or undone[0] in before:
            break
        now = undone[0]
        by = by or undone[1]
        before.add(now)
    if by is None:
        return "remains" if not _LEFT_CHARS.isdisjoint(odd) and _LEFT.search(now) else None, None
    return by, re.sub("\x00([0-9]{1,9})\x00", lambda m: quoted[int(m[1])] if int(m[1]) < len(quoted) else m[0], now)


def repair(text: str) -> tuple[bool, str | None]:
    """(whether the text holds garbled characters, the restored text or None)."""
    by, restored = judged(text)
    return by is not None, restored


def garbled(documents: DataFrame) -> DataFrame:
    """The garbled documents: (doc_id, by, restored), ``restored`` null where nothing could be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ways, texts = [], [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                by, restored = judged(text)
                if by:
                    ids.append(key)
                    ways.append(by)
                    texts.append(restored)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ways, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "by", "restored"])

    suspect = documents.filter(F.col("text").rlike(r"[^\x00-\x7F]|&#?\w+;")).select("doc_id", "text")
    return suspect.mapInArrow(run, "doc_id long, by string, restored string")
