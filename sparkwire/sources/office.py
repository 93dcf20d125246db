"""Texts of DOCX and PDF files, as small helpers of readers.document_files: bytes in, (text, reason) out."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: The most that a member or a stream may unpack to.
MOST = 1 << 28


def extract(data: bytes, ext: str) -> tuple[str | None, str | None]:
    """(text, None), or (None, why there is none)."""
    reader = {"docx": docx_text, "pdf": pdf_text}.get(ext.lower().lstrip("."))
    if reader is None:
        return None, f"no reader for {ext}"
    try:
        return reader(data), None
    except Exception as e:  # a broken file must not end the job: it is told by its row
        return None, f"{type(e).__name__}: {e}"[:200]


def docx_text(data: bytes) -> str:
    """The paragraphs of the body, a line each; tabs and breaks as such."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo("word/document.xml").file_size > MOST:
            raise ValueError("the document is too large")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    breaks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}

    def runs(node):
        for child in node:
            if child.tag == f"{W}r":
                yield from (x.text or "" if x.tag == f"{W}t" else breaks.get(x.tag, "") for x in child)
            elif child.tag in (f"{W}hyperlink", f"{W}ins", f"{W}smartTag"):
                yield from runs(child)

    return "\n".join("".join(runs(p)) for p in (body if body is not None else ()) if p.tag == f"{W}p").strip()


_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_TOKEN = re.compile(rb"%[^\r\n]*|/[^\s/\[\]<>(){}%]*|<<|>>|[\[\]{}]|<[0-9A-Fa-f\s]*>|\(|[^\s/\[\]<>(){}%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _Pdf:
    """Objects of a PDF: (dictionary's bytes, stream's bytes or None) by number."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted")
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        at = 0
        while m := _OBJECT.search(data, at):
            end = data.find(b"endobj", m.end())
            end = len(data) if end < 0 else end
            s = _STREAM.search(data, m.end(), end)
            if s:
                head = data[m.end() : s.start()]
                size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
                stop = s.end() + int(size[1]) if size and data[s.end() + int(size[1]) :].lstrip()[:9] == b"endstream" else data.find(b"endstream", s.end())
                self.objects[int(m[1])] = head, data[s.end() : stop]
                at = max(stop, data.find(b"endobj", stop))
            else:
                self.objects[int(m[1])] = data[m.end() : end], None
                at = end
        for number in [n for n, (head, s) in self.objects.items() if s is not None and re.search(rb"/Type\s*/ObjStm", head)]:
            head = self.objects[number][0]
            body, first = self.stream(number), int(re.search(rb"/First\s+(\d+)", head)[1])
            pairs = list(map(int, body[:first].split()))
            starts = [*pairs[1::2], len(body) - first]
            for k, n in enumerate(pairs[::2]):
                self.objects.setdefault(n, (body[first + starts[k] : first + starts[k + 1]], None))

    def stream(self, number: int) -> bytes:
        head, data = self.objects[number]
        if data is None:
            return b""
        filters = re.findall(rb"/(\w+Decode|Fl|AHx)\b", head)
        for name in filters:
            if name in (b"FlateDecode", b"Fl"):
                unpack = zlib.decompressobj()
                data = unpack.decompress(data, MOST)
                if unpack.unconsumed_tail:
                    raise ValueError("a stream is too large")
            elif name in (b"ASCIIHexDecode", b"AHx"):
                data = bytes.fromhex(data.split(b">")[0].decode("ascii"))
            else:
                raise ValueError(f"filter {name.decode()}")
        return data

    def refs(self, head: bytes, key: bytes) -> list[int]:
        """The numbers that a key refers to, alone or in an array."""
        m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R|\[([^\]]*)\])", head)
        if not m:
            return []
        return [int(m[1])] if m[1] else [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[2])]

    def dictionary(self, head: bytes, key: bytes) -> bytes | None:
        """A dictionary under a key, in place or referred to."""
        m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R|<<)", head)
        if not m:
            return None
        if m[1]:
            return self.objects.get(int(m[1]), (b"", None))[0]
        depth, at = 1, m.end()
        while depth and (x := re.compile(rb"<<|>>").search(head, at)):
            depth, at = depth + (1 if x[0] == b"<<" else -1), x.end()
        return head[m.end() : at]

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, its resources) in reading order."""
        out, seen = [], set()

        def walk(number: int, resources: bytes) -> None:
            if number in seen or number not in self.objects:
                return
            seen.add(number)
            head = self.objects[number][0]
            own = self.dictionary(head, b"Resources")
            resources = resources if own is None else own
            if re.search(rb"/Type\s*/Pages\b", head):
                for kid in self.refs(head, b"Kids"):
                    walk(kid, resources)
            elif re.search(rb"/Type\s*/Page\b", head):
                out.append((head, resources))

        for head, _ in list(self.objects.values()):
            if re.search(rb"/Type\s*/Catalog\b", head):
                for n in self.refs(head, b"Pages"):
                    walk(n, b"")
        return out

    def fonts(self, resources: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """For each font with a map to Unicode: bytes of a code, and the map."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.dictionary(resources, b"Font") or b""):
            if to := self.refs(self.objects.get(int(number), (b"", None))[0], b"ToUnicode"):
                out[name] = _cmap(self.stream(to[0]))
        return out


def _cmap(data: bytes) -> tuple[int, dict[int, str]]:
    hexes = lambda b: [x.replace(b" ", b"") for x in re.findall(rb"<([0-9A-Fa-f\s]*)>", b)]
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    width = max((len(h) // 2 for block in re.findall(rb"begincodespacerange(.*?)endcodespacerange", data, re.DOTALL) for h in hexes(block)), default=1)
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.DOTALL):
        h = hexes(block)
        out |= {int(a, 16): text(b) for a, b in zip(h[::2], h[1::2], strict=False)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.DOTALL):
        for a, b, listed, first in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:\[([^\]]*)\]|<([0-9A-Fa-f]+)>)", block):
            low, high = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
            if listed:
                out |= {low + k: text(h) for k, h in enumerate(hexes(listed))}
            else:
                start = text(first)
                out |= {low + k: start[:-1] + chr(ord(start[-1]) + k) for k in range(high - low + 1)}
    return width, out


def _tokens(data: bytes):
    """Operators and operands of a content stream; strings as ("s", bytes), arrays' brackets as they are."""
    at = 0
    while m := _TOKEN.search(data, at):
        word, at = m[0], m.end()
        if word == b"(":
            out, depth = bytearray(), 1
            while at < len(data):
                c = data[at : at + 1]
                at += 1
                if c == b"\\":
                    c = data[at : at + 1]
                    at += 1
                    if octal := re.compile(rb"[0-7]{1,3}").match(data, at - 1):
                        out.append(int(octal[0], 8) & 255)
                        at = octal.end()
                    elif c == b"\r" or c == b"\n":
                        at += c == b"\r" and data[at : at + 1] == b"\n"
                    else:
                        out += _ESCAPES.get(c, c)
                    continue
                depth += (c == b"(") - (c == b")")
                if not depth:
                    break
                out += c
            yield "s", bytes(out)
        elif word[:1] == b"<" and word != b"<<":
            h = re.sub(rb"\s", b"", word[1:-1])
            yield "s", bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        elif word[:1] != b"%":
            if word == b"ID":  # an inline image's bytes
                end = re.compile(rb"\sEI\b").search(data, at)
                at = end.end() if end else len(data)
            yield "w", word


def _page_text(content: bytes, fonts: dict) -> str:
    out, stack, font, height = [], [], None, None

    def show(raw: bytes) -> None:
        if font in fonts:
            width, to = fonts[font]
            out.append("".join(to.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width)))
        else:
            out.append(raw.decode("cp1252", "replace"))

    def number(k: int) -> float:
        try:
            return float(stack[k][1])
        except (IndexError, ValueError):
            return 0.0

    for kind, word in _tokens(content):
        if kind == "s" or not re.fullmatch(rb"[A-Za-z'\"][A-Za-z0-9*'\"]*", word):
            stack.append((kind, word))
            continue
        if word == b"Tf" and len(stack) > 1:
            font = stack[-2][1].lstrip(b"/")
        elif word in (b"Td", b"TD"):
            out.append("\n" if number(-1) else " ")
        elif word == b"Tm":
            out.append("\n" if height is not None and number(-1) != height else "")
            height = number(-1)
        elif word in (b"T*", b"'", b'"'):
            out.append("\n")
        if word in (b"Tj", b"'", b'"'):
            show(next((w for k, w in reversed(stack) if k == "s"), b""))
        elif word == b"TJ":
            for k, w in stack:
                if k == "s":
                    show(w)
                elif re.fullmatch(rb"-\d+(\.\d*)?", w) and float(w) < -200:  # a gap as wide as a blank
                    out.append(" ")
        stack.clear()
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(out).split("\n"))
    return re.sub(r"\n{2,}", "\n", "\n".join(lines)).strip()


def pdf_text(data: bytes) -> str:
    """The text of each page by its text operators, a blank line between pages."""
    pdf = _Pdf(data)
    pages = pdf.pages()
    if not pages:
        raise ValueError("no pages")
    return "\n\n".join(_page_text(b"\n".join(pdf.stream(n) for n in pdf.refs(page, b"Contents") if n in pdf.objects), pdf.fonts(resources)) for page, resources in pages).strip()
