"""Text of PDF files with the standard library: Flate streams, object streams, the page tree, text operators, ToUnicode maps."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

WORD_GAP_UNITS = -200  # a kerning step beyond this, in thousandths of an em, is a gap between words
TOKEN = re.compile(rb"%[^\r\n]*|\((?:[^()\\]|\\.)*\)|<<|>>|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|\[|\]|[^\s()<>\[\]{}/%]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(token: bytes) -> bytes:
    """The bytes of a (string) token."""

    def one(m: re.Match) -> bytes:
        e = m[1]
        return bytes([int(e, 8) & 255]) if e.isdigit() else ESCAPES.get(e, b"" if e in b"\r\n" else e)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _hexed(token: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", token[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Document:
    """The objects of a file by number: the text before a stream, and the stream's decoded bytes."""

    def __init__(self, content: bytes):
        if not content.lstrip()[:5].startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\b", content):
            raise ValueError("the PDF file is encrypted")
        self.objects: dict[int, tuple[bytes, bytes]] = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.S):
            head, found, rest = m[2].partition(b"stream")
            if found and rest[:1] in (b"\r", b"\n") and (end := rest.rfind(b"endstream")) >= 0:
                body = rest[:end].removeprefix(b"\r\n") if rest.startswith(b"\r\n") else rest[1:end]
                self.objects[int(m[1])] = (head, self._decoded(head, body))
            else:
                self.objects[int(m[1])] = (m[2], b"")
        for head, body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", head):
                self._unpack(head, body)

    @staticmethod
    def _decoded(head: bytes, body: bytes) -> bytes:
        if b"FlateDecode" not in head:
            return body if b"/Filter" not in head else b""
        try:
            return zlib.decompressobj().decompress(body)
        except zlib.error:
            return b""

    def _unpack(self, head: bytes, body: bytes) -> None:
        first = re.search(rb"/First\s+(\d+)", head)
        if not first:
            return
        numbers = [int(x) for x in body[: int(first[1])].split()]
        at = [int(first[1]) + x for x in numbers[1::2]]
        for n, low, high in zip(numbers[::2], at, [*at[1:], len(body)], strict=False):
            self.objects.setdefault(n, (body[low:high], b""))

    def refs(self, head: bytes, key: bytes) -> list[int]:
        """The objects that an entry of a dictionary names, alone or in a list; a list may be an object of its own."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
        if not m:
            return []
        found = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]
        if len(found) == 1 and self.objects.get(found[0], (b"", b""))[0].lstrip().startswith(b"["):
            return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", self.objects[found[0]][0])]
        return found

    def pages(self) -> list[int]:
        """Page objects in the order of the page tree; without one in the order of their numbers."""
        is_page = lambda h: re.search(rb"/Type\s*/Page\b", h)
        out, seen = [], set()
        roots = [n for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Pages\b", h) and b"/Parent" not in h]
        stack = roots[::-1]
        while stack:
            n = stack.pop()
            if n in seen or n not in self.objects:
                continue
            seen.add(n)
            head = self.objects[n][0]
            if is_page(head):
                out.append(n)
            else:
                stack += self.refs(head, rb"Kids")[::-1]
        return out or sorted(n for n, (h, _) in self.objects.items() if is_page(h))

    def inherited(self, page: int, key: bytes) -> bytes:
        """The dictionary text in which a page or one of its parents has the key."""
        seen = set()
        while page in self.objects and page not in seen:
            seen.add(page)
            head = self.objects[page][0]
            if m := re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R|<<)", head):
                return self.objects.get(int(m[1]), (b"", b""))[0] if m[1] else head[m.start() :]
            parent = self.refs(head, rb"Parent")
            page = parent[0] if parent else -1
        return b""

    def fonts(self, page: int) -> dict[bytes, dict[int, str]]:
        """The ToUnicode maps of a page's fonts by name; a font without one isn't among them."""
        resources, out = self.inherited(page, rb"Resources"), {}
        m = re.search(rb"/Font\s*(?:(\d+)\s+\d+\s+R|<<(.*?)>>)", resources, re.S)
        listed = b"" if not m else self.objects.get(int(m[1]), (b"", b""))[0] if m[1] else m[2]
        for name, n in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", listed):
            to = self.refs(self.objects.get(int(n), (b"", b""))[0], rb"ToUnicode")
            if to and to[0] in self.objects:
                out[name] = unicode_map(self.objects[to[0]][1])
        return out


def unicode_map(cmap: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "ignore")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            low, high = int(a, 16), int(b, 16)
            if c:
                out |= {k: chr(int(c, 16) + k - low) for k in range(low, min(high, low + 0xFFFF) + 1) if int(c, 16) + k - low < 0x110000}
            else:
                out |= {low + i: text(x) for i, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", listed))}
    return out


def _shown(raw: bytes, font: dict[int, str] | None) -> str:
    if font is None:
        return raw.decode("utf-16-be", "ignore") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "ignore")
    wide = any(k > 255 for k in font) or (len(raw) % 2 == 0 and raw[:1] == b"\0")
    codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if wide else list(raw)
    return "".join(font.get(c, "") for c in codes)


def page_text(stream: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """What the text operators of a page show; a new line or a wide step counts as a blank."""
    out, stack, font = [], [], None
    for m in TOKEN.finditer(stream):
        t = m[0]
        if t[:1] == b"(":
            stack.append(_literal(t))
        elif t[:1] == b"<" and t != b"<<":
            stack.append(_hexed(t))
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                out.append(" ")
            for x in stack:
                if isinstance(x, bytes):
                    out.append(_shown(x, font))
                elif isinstance(x, float) and t == b"TJ" and x < WORD_GAP_UNITS:
                    out.append(" ")
            stack = []
        elif t == b"Tf":
            names = [x[1] for x in stack if isinstance(x, tuple)]
            font, stack = fonts.get(names[-1]) if names else None, []
        elif t[:1] == b"/":
            stack.append(("name", t[1:]))
        elif re.fullmatch(rb"[+-]?\d*\.?\d+\.?", t):
            stack.append(float(t.rstrip(b".")))
        elif t not in (b"[", b"]"):
            if t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                out.append(" ")
            stack = []
    return " ".join("".join(out).split())


def page_texts(content: bytes) -> Iterator[tuple[int, str]]:
    """(page, text) of every page that shows any text, white space collapsed. Pictures of text show none. Raises ValueError
    for what is no PDF file and for encrypted ones."""
    doc = Document(content)
    for n, page in enumerate(doc.pages(), 1):
        stream = b"\n".join(doc.objects[x][1] for x in doc.refs(doc.objects[page][0], rb"Contents") if x in doc.objects)
        if text := page_text(stream, doc.fonts(page)):
            yield n, text
