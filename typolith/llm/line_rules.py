"""Quality rules, line first: lines that fail are removed, and a document that loses too much goes.

A line fails when it has a word and
* punctuation: symbols (``#*$%&|<>``) reach a fifth of its words, or exclamation
  marks half of its words (three words or more), or it has no terminal mark and
  fewer than one of ``.,;:!?`` for eight words;
* navigation: one-character separators are two or more and a fifth of its words,
  or all of its one to four words are menu words;
* boilerplate: it holds a stock phrase (English, French, German or Spanish; A-Z in
  either case), or four tenths or more of its words (five
  words or more) repeat the word before.

A document is rejected if the base rules fail (fewer than ``min_words`` words, or
over ``max_repeat`` per cent of them in 8-word windows that repeat) or if the lines
removed hold over ``max_lost`` of its word characters.  Null and empty texts have no
words, so they are rejected.  Rows are independent: ties and repeated rows get equal
results.  Columns with the name of a result are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytescan import Chunk, counts_per_row, grams, mix
from .rowmap import map_text

SYMBOLS = b"#*$%&|<>"
SEPARATORS = ["|", "»", "›", "·", "•", ">", "/", "-", "–", "—", "::"]
MENU_WORDS = ["home", "about", "contact", "login", "logout", "register", "search", "menu", "next", "previous", "back", "top", "sitemap", "help", "faq", "share", "print", "subscribe", "skip", "more", "us", "up", "in", "sign"]
MENU_WORDS += ["accueil", "connexion", "inscription", "rechercher", "recherche", "suivant", "précédent", "retour", "aide", "imprimer", "partager"]
MENU_WORDS += ["startseite", "kontakt", "anmelden", "abmelden", "registrieren", "suche", "weiter", "zurück", "hilfe", "impressum", "drucken", "teilen"]
MENU_WORDS += ["inicio", "contacto", "entrar", "registrarse", "buscar", "siguiente", "anterior", "volver", "ayuda", "menú", "imprimir", "compartir"]
PHRASES = ["all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "use cookies", "uses cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "read more", "sign up for our newsletter", "subscribe to our", "powered by", "skip to content", "back to top", "licensed under the", "without warranties or conditions of any kind"]
PHRASES += ["tous droits réservés", "politique de confidentialité", "lire la suite", "cliquez ici", "utilise des cookies"]
PHRASES += ["alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "verwendet cookies"]
PHRASES += ["todos los derechos reservados", "política de privacidad", "condiciones de uso", "leer más", "haga clic aquí", "utiliza cookies"]

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_failed_lines long, lost_chars long, base_failed boolean, kept boolean, cleaned_text string"

_ENDS = np.array([ord(c) for c in ".!?"], np.uint8)
_CLOSERS = np.array([ord(c) for c in "\"')]}*_"], np.uint8)
_WIDE_ENDS = np.array([int.from_bytes(c.encode(), "big") for c in "…。！？”’›"] , np.int64)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_IS_SYMBOL, _IS_MARK, _IS_BANG = _table(SYMBOLS), _table(b".,;:!?"), _table(b"!")
_PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))


def _named(words: list[str]) -> np.ndarray:
    """Span hashes of given words, as a chunk would hash them."""
    data = [w.encode() for w in words]
    offs = np.cumsum([0, *map(len, data)])
    c = Chunk(np.frombuffer(b"".join(data), np.uint8), offs, np.arange(len(data)))
    return np.unique(c.span_hash(offs[:-1], offs[1:]))


def _within(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    s = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=s[1:])
    return s[end] - s[start]


def repeated_words(h: np.ndarray, row: np.ndarray, n_rows: int, size: int = 8) -> np.ndarray:
    """Words of each row within windows of size words that its text has twice or more."""
    g, at = grams(h, row, size)
    cover = np.zeros(len(h) + 1, np.int64)
    if len(g):
        key = mix(g ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + size, -1)
    return counts_per_row(row[np.cumsum(cover)[:-1] > 0], n_rows)


def _judge(c: Chunk, min_words: int, max_repeat: int, max_lost: float, with_text: bool) -> dict:
    buf, n = c.buf, c.n
    ws, we, wr = c.words()
    h = c.span_hash(ws, we)
    n_words = counts_per_row(wr, n)
    head = (buf & 0xC0) != 0x80  # the first byte of each code point
    word_cp = _within(head, ws, we)
    word_chars = counts_per_row(wr, n, word_cp.astype(float)).astype(np.int64)
    n_symbols = _within(_IS_SYMBOL[buf], c.offs[:-1], c.offs[1:])
    n_repeat = repeated_words(h, wr, n)

    ls, le, lr = c.spans(buf == 10)
    w0, w1 = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    worded = w1 > w0
    ls, le, lr, w0, w1 = (a[worded] for a in (ls, le, lr, w0, w1))
    key = mix(c.span_hash(ls, le) ^ mix(lr.astype(np.uint64) + np.uint64(1)))
    first = np.unique(key, return_index=True)[1]
    n_lines = counts_per_row(lr, n)
    n_dup = n_lines - counts_per_row(lr[first], n)

    lw = w1 - w0
    low = c.lowered()
    lh = low.span_hash(ws, we)
    last = we[w1 - 1] - 1 if len(ls) else ls
    stop = last.copy()
    for _ in range(2):
        stop = np.where(np.isin(buf[stop], _CLOSERS) & (stop > ls), stop - 1, stop) if len(ls) else stop
    wide = np.zeros(len(ls), np.int64)
    for k in (2, 1, 0):
        wide = (wide << 8) | buf[np.maximum(last - k, 0)] if len(ls) else wide
    terminal = np.isin(buf[stop], _ENDS) | np.isin(wide, _WIDE_ENDS) if len(ls) else np.zeros(0, bool)
    symbols, marks, bangs = (_within(t[buf], ls, le) for t in (_IS_SYMBOL, _IS_MARK, _IS_BANG))
    fail = (symbols >= np.maximum(2, 0.2 * lw)) | ((bangs >= 0.5 * lw) & (lw >= 3)) | (~terminal & (marks * 8 < lw))
    seps = _within(np.isin(h, _named(SEPARATORS)), w0, w1)
    menu = _within(np.isin(lh, _named(MENU_WORDS)), w0, w1)
    fail |= ((seps >= 2) & (seps >= 0.2 * lw)) | ((menu == lw) & (lw <= 4))
    stutter = np.zeros(len(h), bool)
    stutter[1:] = h[1:] == h[:-1]
    fail |= (_within(stutter, np.minimum(w0 + 1, w1), w1) >= 0.4 * lw) & (lw >= 5)
    if len(ls):
        stock = np.array([m.start() for m in _PHRASE.finditer(low.buf.tobytes())], np.int64)
        at = np.searchsorted(ls, stock, side="right") - 1
        ok = at >= 0
        ok[ok] &= stock[ok] < le[at[ok]]
        fail[at[ok]] = True
    cp = np.concatenate([[0], np.cumsum(word_cp)])
    lost = counts_per_row(lr[fail], n, (cp[w1] - cp[w0])[fail].astype(float)).astype(np.int64)
    base_failed = (n_words < min_words) | (100 * n_repeat > max_repeat * n_words)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_lines": n_lines, "n_failed_lines": counts_per_row(lr[fail], n), "lost_chars": lost, "base_failed": base_failed, "kept": ~base_failed & (lost <= max_lost * word_chars)}
    texts: list[str | None] = [None] * n
    if with_text:
        bad = np.split(np.flatnonzero(fail), np.searchsorted(lr[fail], np.arange(1, n)))
        for k in range(n):
            lo, hi = int(c.offs[k]), int(c.offs[k + 1])
            parts, at = [], lo
            for i in bad[k]:  # a line goes with the break after it
                parts.append(buf[at : ls[i]].tobytes())
                at = min(int(le[i]) + 1, hi)
            parts.append(buf[at:hi].tobytes())
            whole = b"".join(parts)
            texts[k] = (whole.rstrip(b"\n") if len(bad[k]) else whole).decode("utf-8", "replace")
    return out | {"cleaned_text": pa.array(texts, pa.string())}


def clean_lines(docs: DataFrame, text_col: str = "text", *, min_words: int = 20, max_repeat: int = 30, max_lost: float = 0.5, with_text: bool = True) -> DataFrame:
    """The rows of docs with the counts and verdicts above; cleaned_text is null without with_text."""
    return map_text(docs, text_col, SCHEMA, lambda c: _judge(c, min_words, max_repeat, max_lost, with_text))
