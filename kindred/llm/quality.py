"""Quality rules, lines first."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from kindred.llm.shared import BLANKS, with_columns

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: From this number of words on, windows are compared as numbers in sorted arrays, which takes less memory.
MANY_WORDS = 50_000

#: Ends of a sentence, also behind closing marks.
ENDS = re.compile(r"[.!?:;…。！？؟।][\"'”’»)\]*_]*$")
SENTENCE = re.compile(r"[.!?…。！？؟।](?:\s|$)")
SEPARATORS = re.compile(r"(?:^|\s)[|»›•·>/]+(?=\s|$)")
BOILERPLATE = re.compile(
    r"lorem ipsum|enable javascript|javascript is (?:disabled|required)|privacy policy|terms of (?:use|service)"
    r"|all rights reserved|click here|read more|sign (?:in|up)\b|log ?in\b|subscribe (?:to|now)|share (?:this|on)|skip to (?:main )?content|powered by|back to top"
    r"|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|hier klicken|weiterlesen|javascript aktivieren|zum seitenanfang"
    r"|tous droits réservés|politique de confidentialité|conditions d['’]utilisation|cliquez ici|lire la suite|activer javascript|haut de page"
    r"|todos los derechos reservados|política de privacidad|términos (?:de uso|y condiciones)|haga clic aquí|leer más|habilitar javascript|volver arriba",
    re.IGNORECASE,
)
#: A notice of cookies has one of some words somewhere behind the first cookie, or before the last.
COOKIE, BEHIND, BEFORE = (re.compile(x, re.IGNORECASE) for x in (r"\bcookies?\b", r"\b(?:use|accept|policy|consent|akzeptieren|accepter|aceptar)", r"(?:use|accept)\b"))


def notice(line: str) -> bool:
    """Whether a line speaks of cookies as notices do; in time linear in its length."""
    found = [m.span() for m in COOKIE.finditer(line)]
    return bool(found) and (any(m.start() >= found[0][1] for m in BEHIND.finditer(line)) or any(m.end() <= found[-1][0] for m in BEFORE.finditer(line)))


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of a document. A line of fewer than few_words words must end like a sentence; a longer
    one must end like one or have one within. Shares are of a line's words or characters without blanks."""

    few_words: int = 8
    separator_share: float = 0.15
    symbol_share: float = 0.1
    boilerplate_words: int = 30
    shouting_words: int = 5
    monotone_words: int = 20
    monotone_share: float = 0.25
    most_lost: float = 0.5
    least_words: int = 10


def repeated_words(words: list[bytes]) -> int:
    """Words within windows of five words that occur twice or more in the list, each occurrence counted."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) < MANY_WORDS:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        twice = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    else:
        ids: dict[bytes, int] = {}
        single = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        window = single[:n]
        for i in range(1, WINDOW):  # numbers of windows of i + 1 words; a pair of numbers stays below 2^63
            window = np.unique(window * (len(ids) + 1) + single[i : i + n], return_inverse=True)[1]
        twice = np.bincount(window)[window] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:n] += twice
    covered[WINDOW : n + WINDOW] -= twice
    return int((np.cumsum(covered)[:-1] > 0).sum())


def bad_line(line: str, rules: Rules) -> str | None:
    """The rule that a line with words breaks, if any."""
    words = line.split()
    n = len(words)
    solid = "".join(words)
    separators = len(SEPARATORS.findall(line))
    if separators >= 2 and separators >= rules.separator_share * n:
        return "navigation"
    if sum(map(solid.count, SYMBOLS)) > rules.symbol_share * len(solid):
        return "symbols"
    if n >= rules.shouting_words:
        letters = [c for c in solid if c.isupper() or c.islower()]
        if len(letters) >= 10 and sum(map(str.isupper, letters)) > 0.8 * len(letters):
            return "shouting"
    if n >= rules.monotone_words and len(set(words)) <= rules.monotone_share * n:
        return "monotone"
    if n <= rules.boilerplate_words and (BOILERPLATE.search(line) or notice(line)):
        return "boilerplate"
    if not ENDS.search(line.rstrip()) and (n < rules.few_words or not SENTENCE.search(line)):
        return "punctuation"
    return None


def assess(text: str | None, rules: Rules = Rules()) -> dict:
    """Counts, verdict and cleaned text of one document."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen: set[str] = set()
    duplicates = bad_lines = lost = 0
    stays = []
    for line in text.split("\n"):
        if not (bare := line.strip(BLANKS)):
            stays.append(line)
            continue
        duplicates += line in seen
        seen.add(line)
        if bad_line(bare, rules):
            bad_lines += 1
            lost += len(bare.encode("utf-8", "surrogatepass").split())
        else:
            stays.append(line)
    repeated = repeated_words(words)
    failed = n < rules.least_words or 100 * repeated > 20 * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated,
        "base_failed": failed,
        "n_bad_lines": bad_lines,
        "n_lost_words": lost,
        "kept": not failed and lost <= rules.most_lost * n,
        "clean_text": "\n".join(stays) if bad_lines else text,
    }


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bad_lines long, n_lost_words long, kept boolean, clean_text string"


def clean_lines(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Adds counts, the verdict kept and clean_text (the text without lines that break a rule) to every row.

    Each line with a word is judged by itself: navigation (separators between few words), symbols, shouting, one word over
    and over, boilerplate phrases in short lines, and punctuation (no end of a sentence). A document is rejected if the lines
    that go hold over half of its words; or before that by its base counts. Null counts as
    empty text: no words, rejected. Input columns of the results' names are replaced, all other columns stay. Rows are
    judged one by one within Arrow batches, nothing is exchanged; ties, repeated rows and empty tables need no rule.
    """

    def run(texts):
        for text in texts:
            yield tuple(assess(text, rules).values())

    return with_columns(docs, [text_col], RESULT, run)
