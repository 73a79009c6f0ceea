"""Running prose of a text: what is left without markup, code, tables, data, notices, headings and links."""

from __future__ import annotations

import html
import re
import unicodedata

# Frequent function words of English prose, and of its neighbours here.
ENGLISH = frozenset(
    "the a an of in on at to and or but is are was were be it its we you he she they i my our your his her their "
    "with for from by as that this these then when while because although if until unless before after so not do does "
    "can has have had why look put one every first there what which who into near under over than too".split()
)
# Frequent function words of other languages that English prose lacks.
FOREIGN = frozenset(
    "der die das und ist ein eine einen dem den nicht mit auf im zu von wird sich sehr le la les des un une et est dans "
    "sur pour qui du au aux el los las una y en de del por se su muy otra sin que il lo gli di e che per non con".split()
)
# Words that legal notices use and prose here doesn't.
NOTICE = re.compile(
    r"(?:redistribut|warrant|copyright|all rights reserved|licen[cs]ed? under|merchantab|permission is hereby|\(c\) ?\d{4}|liabilit"
    r"|provided that attribution|derivative compilations|without express)",
    re.I,
)
NOTICE_STEMS = (
    "redistribut", "warrant", "copyright", "rights reserved", "licen", "merchantab", "permission is hereby", "(c)", "liabilit",
    "provided that attribution", "derivative compilations", "without express",
)
_INVISIBLE = {c: None for c in [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x200E, 0x200F]}
_BLOCK_TAG = re.compile(r"</?(?:p|div|br|li|ul|ol|blockquote|section|article|tr|body|html|hr)\b[^>]*>", re.I)
_DROP_TAG = re.compile(r"<(script|style|pre|code|table|h[1-6]|title|a|nav|footer)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_LINK = re.compile(r"\[([^\]]*)\]\([^)\s]*\)|(?:https?://|www\.)\S+|\S+@\S+\.\w+")
_MARK = re.compile(r"^[ \t]*(?:(?:[-*+•‣·–—]|>+|\d{1,3}[.)]|\(\d{1,3}\))[ \t]+)+")
_OTHER = re.compile(r"[\W\d_]+")
_CODE_MARK = re.compile(r"[;:{}=(]")
_WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")
_CODE = re.compile(r"[;{}=]\s*$|^\s*(?:def|for|if|while|return|import|class|var|let|const|function)\b.*[:({;]|\w+\(.*\)\s*;?\s*$|^\s*\w+(\[[^\]]*\])?\s*=[^=]")


def cleaned(text: str) -> str:
    """Compatible form without invisible characters, entities and damaged quotes; spaces unified."""
    if "&" in text:
        text = html.unescape(text)
    if "â€" in text:
        text = re.sub(r"â€(?:œ|\x9d|™|˜|“|”|¦|¢)?", "'", text)
    return unicodedata.normalize("NFKC", text).translate(_INVISIBLE)


def words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower().replace("’", "'"))


def is_english(found: list[str]) -> bool:
    """Whether a run of words is English prose: enough English function words, and more than foreign ones."""
    english = sum(w in ENGLISH for w in found)
    foreign = sum(w in FOREIGN for w in found)
    return english >= max(1, 0.08 * len(found)) and english > foreign


def blocks(text: str) -> list[str]:
    """Paragraphs or list entries of running text, with hard line breaks and broken words mended."""
    text = cleaned(text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _DROP_TAG.sub("\n\n", text)
        text = _BLOCK_TAG.sub("\n\n", text)
        text = _TAG.sub(" ", text)
    text = _LINK.sub(" ", text)
    found: list[str] = []
    open_block: list[str] = []

    def close() -> None:
        if open_block:
            found.append(re.sub(r"(\w)-\n(?=[a-z])", r"\1", "\n".join(open_block)).replace("\n", " "))
            open_block.clear()

    for raw in text.split("\n"):
        line = raw.strip()
        marked = _MARK.match(raw)
        body = _MARK.sub("", raw).strip() if marked else line
        letters = len(_OTHER.sub("", body))
        quoted = line.startswith(">")
        if (
            not body
            or re.match(r"#{1,6}\s", line)
            or body.count("|") >= 2
            or "\t" in body and len(re.findall(r"\t", body)) >= 2 and letters < 0.6 * len(body)
            or letters < 0.5 * len(body)
            or _CODE_MARK.search(raw) and _CODE.search(raw)
        ):
            close()
            continue
        if marked and not quoted:
            close()
        open_block.append(body)
    close()
    return found


def sentences(text: str) -> list[list[str]]:
    """Word lists of the English prose sentences of a text; null and empty texts have none.

    A block that ends without a stop ends its sentence. Headings (short lines
    without a stop), notices and runs that aren't English prose are left out.
    """
    found = []
    low = (text or "").lower()
    noticed = any(stem in low for stem in NOTICE_STEMS)
    for block in blocks(text or ""):
        if noticed and NOTICE.search(block):
            kept = [s for s in re.split(r"(?<=[.!?])\s+", block) if not NOTICE.search(s)]
            block = " ".join(kept)
        stops = re.search(r"[.!?…]", block)
        for s in re.split(r"(?<=[.!?…])[\"'”’)]*\s+", block):
            ws = words(s)
            if not ws or (not stops and len(ws) < 4) or not is_english(ws):
                continue
            found.append(ws)
    return found
