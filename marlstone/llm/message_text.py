"""The message behind a rendered record, and its words without mere typography."""

from __future__ import annotations

import html
import re
import unicodedata

# Marks of forwarding, and the headers that the archive renderers put before a message.
_MARK = r"(?:(?:FYI|FWD?|RE|AW|WG)\s*(?:[:—–-]+\s*)+|\((?:repost|fwd?|forwarded)\)\s*)"
_HEADERS = [
    r"\[\d{4}-\d\d-\d\d[^\]\n]*\]:[ \t]?",
    r"\[\d{4}-\d\d-\d\d[^\]\n]*\]\s+From:[^\n]*\n(?:To:[^\n]*\n|Cc:[^\n]*\n)*(?:Subject:[^\n]*(?:\n\s*|$))?",
    r"\[(?:chatgpt|claude\.ai) conversation:[^\n]*\]\s*(?:@\w+:[ \t]?)?",
    r"csv:[^\n]*(?:\n\s*|$)(?:\w+:[ \t])?",
]
_FRONT = re.compile(rf"\s*(?:{_MARK}|{'|'.join(_HEADERS)})", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^>]{0,200}>")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("авеёзікмнорстухјѕԁһɡαεικνορτυχ", "abeeeikmhopctyxjsdhgaeikvoptux")
_DROP = {c: None for c in range(128) if not chr(c).isalnum() and not chr(c).isspace()}


def behind_header(body: str) -> str:
    """The message of a rendered record: headers and marks of forwarding cut off its front."""
    at = 0
    while (m := _FRONT.match(body, at)) and m.end() > at:
        at = m.end()
    return body[at:]


def _plain(word: str) -> str:
    """A word without accents, invisible characters and signs; look-alikes in Latin words replaced."""
    word = "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", word)) if c.isalnum() or c.isspace())
    return word.translate(LOOKALIKES) if re.search("[a-z]", word) else word


def message_words(body: str) -> list[str]:
    """Lower-case words of the message; case, accents, signs, markup and entities don't count."""
    text = behind_header(body)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return text.lower().translate(_DROP).split()
    text = unicodedata.normalize("NFKC", text).lower()
    words = (w.translate(_DROP) if w.isascii() else _plain(w) for w in text.split())
    return [part for w in words for part in w.split()]
