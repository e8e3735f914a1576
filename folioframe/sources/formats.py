"""Text of one file, by format.  Each reader takes bytes and yields lines."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

MAX_INFLATED = 512 * 1024 * 1024  # of one entry of a container; more is an error of the file
DAMAGED = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, RuntimeError, NotImplementedError, KeyError, ValueError, EOFError)


def decoded(raw: bytes, codes: tuple[str, ...] = ("utf-8-sig", "cp1251", "latin-1")) -> str:
    """Text in the first code that fits; the last one takes any bytes."""
    *first, last = codes
    for code in first:
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            continue
    return raw.decode(last)


def plain(raw: bytes) -> Iterator[str]:
    yield decoded(raw)


# --- containers of XML -----------------------------------------------------------------------


class Package:
    """Entries of a zipped document, parsed with their sizes checked."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.names = set(self.zip.namelist())

    def data(self, name: str) -> bytes:
        if self.zip.getinfo(name).file_size > MAX_INFLATED:
            raise ValueError(f"{name} is over {MAX_INFLATED} bytes")
        return self.zip.read(name)

    def tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.data(name))

    def targets(self, part: str) -> dict[str, str]:
        """Relation id -> entry, for the relations of a part."""
        folder, _, leaf = part.rpartition("/")
        rels = f"{folder}/_rels/{leaf}.rels"
        if rels not in self.names:
            return {}
        out = {}
        for r in self.tree(rels):
            target = r.get("Target", "")
            steps = target.lstrip("/").split("/") if target.startswith("/") else f"{folder}/{target}".split("/")
            path: list[str] = []
            for s in steps:
                path = path[:-1] if s == ".." else path if s in ("", ".") else [*path, s]
            out[r.get("Id", "")] = "/".join(path)
        return out

    def numbered(self, folder: str, stem: str) -> list[str]:
        """Entries ``folder/stemN.xml`` by their number."""
        rx = re.compile(rf"{re.escape(folder)}/{stem}(\d*)\.xml")
        found = [(int(m[1] or 0), n) for n in self.names if (m := rx.fullmatch(n))]
        return [n for _, n in sorted(found)]


def local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def flow(node: ElementTree.Element) -> Iterator[str]:
    """Lines of a word-processing body: a paragraph each, a table row with its cells."""
    loose: list[str] = []
    for child in node:
        kind = local(child)
        if kind == "p":
            yield "".join(run_text(child))
        elif kind == "tr":
            yield "\t".join(" ".join(filter(None, flow(cell))) for cell in child if local(cell) == "tc")
        elif kind == "t":
            loose.append(child.text or "")
        else:
            yield from flow(child)
    if loose:
        yield " ".join(loose)


def run_text(node: ElementTree.Element) -> Iterator[str]:
    for n in node.iter():
        kind = local(n)
        if kind == "t":
            yield n.text or ""
        elif kind == "tab":
            yield "\t"
        elif kind in ("br", "cr"):
            yield "\n"


def word_document(raw: bytes) -> Iterator[str]:
    yield from flow(Package(raw).tree("word/document.xml"))


def workbook(raw: bytes) -> Iterator[str]:
    """Rows of all sheets, cells separated by tabs; without a sheet, the shared strings."""
    package = Package(raw)
    strings = []
    if "xl/sharedStrings.xml" in package.names:
        strings = ["".join(run_text(item)) for item in package.tree("xl/sharedStrings.xml")]
    sheets = package.numbered("xl/worksheets", "sheet")
    if not sheets:
        yield from (s.strip() for s in strings)
    for sheet in sheets:
        for row in package.tree(sheet).iter():
            if local(row) == "row":
                yield "\t".join(cell_text(c, strings) for c in row).rstrip("\t")


def cell_text(cell: ElementTree.Element, strings: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(run_text(cell))
    value = next((n.text or "" for n in cell if local(n) == "v"), "")
    return strings[int(value)] if cell.get("t") == "s" and value else value


def slide_lines(tree: ElementTree.Element) -> Iterator[str]:
    paragraphs = [n for n in tree.iter() if local(n) == "p" and any(local(c) in ("r", "fld", "br") for c in n)]
    if not paragraphs:
        yield " ".join(n.text or "" for n in tree.iter() if local(n) == "t")
    for p in paragraphs:
        yield "".join(run_text(p))


def slides(raw: bytes) -> Iterator[str]:
    """Slides in the order of the presentation, each followed by its notes."""
    package = Package(raw)
    order = package.numbered("ppt/slides", "slide")
    main = "ppt/presentation.xml"
    if main in package.names:
        targets = package.targets(main)
        ids = [n.get(k, "") for n in package.tree(main).iter() if local(n) == "sldId" for k in n.keys() if k.endswith("}id")]
        listed = [targets[i] for i in ids if targets.get(i) in package.names]
        order = listed + [n for n in order if n not in listed]
    for name in order:
        yield from slide_lines(package.tree(name))
        for note in package.targets(name).values():
            if "/notesSlides/" in note and note in package.names:
                yield from slide_lines(package.tree(note))


# --- rich text --------------------------------------------------------------------------------


RTF_TOKEN = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)?\x20?|\\(.)|([{}])|([^\\{}]+)", re.DOTALL)
RTF_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "themedata", "datastore"}
RTF_BREAKS = {"par": "\n", "line": "\n", "row": "\n", "tab": "\t", "cell": "\t"}


def rich_text(raw: bytes) -> Iterator[str]:
    """Text of the groups that are shown, with escaped bytes and code points resolved."""
    page = re.search(rb"\\ansicpg(\d+)", raw)
    code = f"cp{page[1].decode()}" if page else "cp1252"
    out: list[str] = []
    held = bytearray()  # escaped bytes, which may form one character together
    silent, skip = [False], [1]
    left = 0  # characters that stand for the last code point

    def settle() -> None:
        if held:
            try:
                out.append(held.decode(code, "replace"))
            except LookupError:
                out.append(held.decode("latin-1"))
            held.clear()

    for hexed, word, number, sign, brace, text in RTF_TOKEN.findall(decoded(raw)):
        if not hexed:
            settle()
        if brace == "{":
            silent.append(silent[-1])
            skip.append(skip[-1])
        elif brace:
            if len(silent) > 1:
                silent.pop()
                skip.pop()
        elif sign == "*" or word in RTF_SILENT:
            silent[-1] = True
        elif word == "uc":
            skip[-1] = int(number or 1)
        elif silent[-1]:
            continue
        elif hexed:
            if left:
                left -= 1
            else:
                held.append(int(hexed, 16))
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            left = skip[-1]
        elif word in RTF_BREAKS:
            out.append(RTF_BREAKS[word])
        elif sign:
            out.append({"~": " ", "-": "", "_": "-", "\n": "\n", "\r": "\n"}.get(sign, sign))
        elif text:
            body = text.replace("\r", "").replace("\n", "")
            out.append(body[left:])
            left = max(0, left - len(body))
        elif word:
            out.append(" ")
    settle()
    yield "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


# --- binary files -------------------------------------------------------------------------------

_SHOWN = bytes(c if 32 <= c < 127 or c >= 192 else 10 for c in range(256))


def readable_runs(raw: bytes, least: int = 5) -> Iterator[str]:
    """Runs of printable characters, each once whatever its case."""
    runs = raw.translate(_SHOWN).decode("cp1251", "replace").split("\n")
    first: dict[str, str] = {}
    for run in runs:
        if len(run) >= least:
            first.setdefault(run.casefold(), run)
    yield from first.values()


def text_or_runs(raw: bytes) -> Iterator[str]:
    text = decoded(raw)
    if text.strip():
        yield text
    else:
        yield from readable_runs(raw)


Reader = Callable[[bytes], Iterator[str]]
#: suffix -> (method, reader, whether white space is folded)
READERS: dict[str, tuple[str, Reader, bool]] = {
    ".txt": ("plain_text", plain, False),
    ".md": ("plain_text", plain, False),
    ".csv": ("csv", plain, False),
    ".sdr": ("sdr_text", text_or_runs, False),
    ".rtf": ("rtf_strip", rich_text, True),
    ".docx": ("docx_xml", word_document, True),
    ".xlsx": ("xlsx_strings", workbook, False),
    ".xlsm": ("xlsx_strings", workbook, False),
    ".pptx": ("pptx_xml", slides, False),
    ".xls": ("xls_strings", readable_runs, False),
    ".ppt": ("ppt_strings", readable_runs, False),
}
UNSUPPORTED = frozenset({".pdf", ".doc", ".dwg", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".gif", ".webp", ".bmp"})


def read_text(raw: bytes, kind: str) -> tuple[str, str, str | None]:
    """(text, method, error) of one file that is no archive."""
    if kind in UNSUPPORTED:
        return "", "unsupported", None
    method, reader, fold = READERS.get(kind, ("binary_decode", plain, False))
    try:
        text = "\n".join(line for line in reader(raw) if line.strip())
    except DAMAGED as fault:
        return "", method, f"{type(fault).__name__}: {fault}"
    return (" ".join(text.split()) if fold else text.strip()), method, None


def members(raw: bytes, kinds: frozenset[str]) -> Iterator[tuple[int, str, str, bytes, str | None]]:
    """(number, name, suffix, content, error) of the files of an archive with one of the suffixes."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except DAMAGED as fault:
        yield 0, "", "", b"", f"{type(fault).__name__}: {fault}"
        return
    for n, info in enumerate(archive.infolist()):
        leaf = info.filename.rpartition("/")[2]
        kind = "." + leaf.rpartition(".")[2].lower() if "." in leaf[1:] else ""
        if info.is_dir() or kind not in kinds:
            continue
        try:
            if info.file_size > MAX_INFLATED:
                raise ValueError(f"over {MAX_INFLATED} bytes")
            yield n, info.filename, kind, archive.read(info), None
        except DAMAGED as fault:
            yield n, info.filename, kind, b"", f"{info.filename}: {type(fault).__name__}: {fault}"
