"""Test documents, built from small parts. Nothing in them is executable.

Every document is a list of numbered bodies between a header and a trailer. The
kinds are chosen for what the parser and the rules have to tell apart, with
trees of two levels, chained filters and hostile bytes among them.
"""

from __future__ import annotations

import base64
import zlib

LINE = "Quarterly figures for the northern region, with notes on method and sources. "


class Writer:
    """Collects bodies; the catalog is always object 1 and its page tree object 2."""

    def __init__(self, version: str = "1.6"):
        self.parts = [f"%PDF-{version}\n".encode()]
        self.catalog: list[str] = ["/Type /Catalog", "/Pages 2 0 R"]
        self.kids: list[str] = []
        self.bodies: dict[int, bytes] = {}
        self.next = 10

    def put(self, body: str | bytes, number: int | None = None) -> int:
        number = number or self.next
        self.next = max(self.next, number) + 1
        self.bodies[number] = body.encode("latin-1") if isinstance(body, str) else body
        return number

    def stream(self, data: bytes, keys: str = "", filters: str = "") -> int:
        for name in filters.split():
            data = ENCODERS[name](data)
        if filters:
            names = "".join(f"/{n}Decode" for n in reversed(filters.split()))
            keys += f" /Filter [{names}]"
        return self.put(b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), keys.encode(), data))

    def page(self, keys: str = "", text: str = "") -> int:
        if text:
            keys += f" /Contents {self.stream(f'BT ({text}) Tj ET'.encode())} 0 R"
        number = self.put(f"<< /Type /Page {keys} >>")
        self.kids.append(f"{number} 0 R")
        return number

    def script(self, code: str, where: str = "/OpenAction", filters: str | None = None) -> None:
        if filters is None:
            held = f"({code})"
        else:
            held = f"{self.stream(code.encode(), filters=filters)} 0 R"
        self.catalog.append(f"{where} {self.put(f'<< /S /JavaScript /JS {held} >>')} 0 R")

    def done(self, trailer: str = "", tail: bytes = b"") -> bytes:
        if not self.kids:
            self.page()
        self.bodies.setdefault(1, f"<< {' '.join(self.catalog)} >>".encode("latin-1"))
        kids = " ".join(self.kids)
        self.bodies.setdefault(2, f"<< /Type /Pages /Kids [{kids}] /Count {len(self.kids)} >>".encode())
        objects = [b"%d 0 obj\n%s\nendobj\n" % pair for pair in sorted(self.bodies.items())]
        end = f"trailer\n<< /Size {self.next} /Root 1 0 R {trailer} >>\nstartxref\n0\n%%EOF\n"
        return b"".join([*self.parts, *objects, end.encode(), tail])


def run_length(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"


ENCODERS = {
    "Flate": zlib.compress,
    "ASCIIHex": lambda d: d.hex().encode() + b">",
    "ASCII85": lambda d: base64.a85encode(d) + b"~>",
    "RunLength": run_length,
}


def report() -> bytes:
    w = Writer()
    w.page(text="Net result: 48.2")
    return w.done()


def tree_script() -> bytes:
    """A script in a name tree of two levels."""
    w = Writer()
    action = w.put("<< /S /JavaScript /JS (app.beep\\(0\\);) >>")
    leaf = w.put(f"<< /Names [(first) {action} 0 R] >>")
    root = w.put(f"<< /Kids [{leaf} 0 R] >>")
    w.catalog.append(f"/Names << /JavaScript {root} 0 R >>")
    return w.done()


def exploit_script() -> bytes:
    w = Writer()
    w.script("var p = unescape('%u0c0c%u0c0c');eval(String.fromCharCode(98));util.printf('%45000f', 2);")
    return w.done()


def program_start() -> bytes:
    w = Writer()
    w.catalog.append(f"/OpenAction {w.put('<< /S /Launch /Win << /F (cmd.exe) >> /F (cmd.exe) >>')} 0 R")
    return w.done()


def hex_names() -> bytes:
    w = Writer()
    action = w.put("<< /#53 /J#61vaScript /J#53 (eval(unescape('%u4242'))) >>")
    w.catalog = ["/T#79pe /C#61talog", "/P#61ges 2 0 R", f"/Open#41ction {action} 0 R"]
    return w.done()


def order_form() -> bytes:
    w = Writer()
    w.page(text=LINE * 6)
    w.page()
    w.page()
    packet = w.stream(b"<xdp:xdp></xdp:xdp>")
    w.catalog.append(f"/A#63roForm << /Fields [] /XFA {packet} 0 R >>")
    w.script("this.getField\\('sum'\\).value = 3;")
    return w.done()


def lure() -> bytes:
    w = Writer()
    note = w.put("<< /Type /Annot /Subtype /Link /A << /S /URI /URI (http://192.0.2.44/login) >> >>")
    w.page(f"/Annots [{note} 0 R]", "Sign in to view the document")
    return w.done()


def carrier() -> bytes:
    w = Writer()
    data = w.stream(b"MZ\x90\x00 harmless filler", "/Type /EmbeddedFile")
    spec = w.put(f"<< /Type /Filespec /F (setup.exe) /EF << /F {data} 0 R >> >>")
    leaf = w.put(f"<< /Names [(setup.exe) {spec} 0 R] >>")
    w.catalog.append(f"/Names << /EmbeddedFiles {leaf} 0 R >>")
    return w.done()


def note_action() -> bytes:
    """An annotation whose additional actions hold a script."""
    w = Writer()
    act = w.put("<< /S /JavaScript /JS (hover\\(\\);) >>")
    note = w.put(f"<< /Type /Annot /Subtype /Widget /AA << /E {act} 0 R >> >>")
    w.page(f"/Annots [{note} 0 R]")
    return w.done()


def filtered(filters: str, code: str = "var x = 1;") -> bytes:
    w = Writer()
    w.script(code, filters=filters)
    return w.done()


def redefined() -> bytes:
    """A later definition of the action counts."""
    w = Writer()
    w.script("old\\(\\);")
    return w.done(tail=b"10 0 obj\n<< /S /JavaScript /JS (new\\(\\);) >>\nendobj\n%%EOF\n")


def object_stream() -> bytes:
    """Catalog and action inside a compressed object stream."""
    catalog, action = b"<< /Type /Catalog /Pages 2 0 R /OpenAction 5 0 R >>", b"<< /S /JavaScript /JS (inner\\(\\);) >>"
    header = b"1 0 5 %d " % (len(catalog) + 1)
    w = Writer()
    w.stream(header + catalog + b" " + action, f"/Type /ObjStm /N 2 /First {len(header)}", "Flate")
    data = w.done()
    start = data.index(b"1 0 obj")
    return data[:start] + data[data.index(b"2 0 obj") :]


def cut_deflate() -> bytes:
    """A script in a deflated stream whose second half is gone."""
    w = Writer()
    code = "".join(f"step{i}();" for i in range(400)).encode()
    packed = zlib.compress(code)
    packed = packed[: len(packed) // 2]
    held = w.put(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
    w.catalog.append(f"/OpenAction {w.put(f'<< /S /JavaScript /JS {held} 0 R >>')} 0 R")
    return w.done()


def hostile(kind: str) -> bytes:
    """Bytes that a careless reader trips over, each beside a usable page."""
    w = Writer()
    if kind == "octal":
        w.put("<< /Title (nine \\9 and \\8 and \\778) >>")
    elif kind == "large number":
        return w.done(tail=b"99999999999 0 obj\n<< /A 1 >>\nendobj\n")
    elif kind == "many digits":
        return w.done(tail=b"9" * 5_000 + b" 0 obj\n<< /B " + b"8" * 5_000 + b" 0 R >>\nendobj\n")
    elif kind == "bad header":
        w.put(b"<< /Type /ObjStm /N 1 /First /x /Length 4 >>\nstream\n1 0 \nendstream")
    elif kind == "long trailer":
        return w.done(trailer="/Pad (" + "p" * 70_000 + ")").replace(b"/Root 1 0 R", b"", 1).replace(
            b"p) >>", b"p) /Root 1 0 R >>"
        )
    elif kind == "unknown filter":
        held = w.put(b"<< /Length 3 /Filter /MysteryDecode >>\nstream\nabc\nendstream")
        w.catalog.append(f"/OpenAction {w.put(f'<< /S /JavaScript /JS {held} 0 R >>')} 0 R")
    return w.done()


def deep_pages(depth: int, cycle: bool = False) -> bytes:
    """A page under a chain of tree nodes; with ``cycle`` the last node names the first, too."""
    w = Writer()
    page = w.put("<< /Type /Page >>")
    first = 100
    for i in range(depth - 1):
        kids = f"{first + i + 1} 0 R" if i < depth - 2 else f"{page} 0 R" + (" 2 0 R" if cycle else "")
        w.put(f"<< /Type /Pages /Kids [{kids}] >>", first + i)
    start = f"{first} 0 R" if depth > 1 else f"{page} 0 R"
    w.put(f"<< /Type /Pages /Kids [{start}] >>", 2)
    w.kids.append("unused")
    return w.done()


HOSTILE = ("octal", "large number", "many digits", "bad header", "long trailer", "unknown filter")

ALL = {
    "report": report(),
    "tree_script": tree_script(),
    "exploit_script": exploit_script(),
    "program_start": program_start(),
    "hex_names": hex_names(),
    "order_form": order_form(),
    "lure": lure(),
    "carrier": carrier(),
    "note_action": note_action(),
    "tail_data": report() + b"\n" + b"UNRELATED-DATA" * 320,
    "late_header": b"\t" * 80 + report(),
    "noise": b"%PDF-1.3\n" + bytes(range(128, 256)) * 8 + b"\ntrailer\n<< /Root 77 0 R >>\n%%EOF\n",
    "deflated": filtered("Flate"),
    "chained": filtered("Flate ASCIIHex"),
    "redefined": redefined(),
    "object_stream": object_stream(),
    "cut_deflate": cut_deflate(),
    **{f"hostile {k}": hostile(k) for k in HOSTILE},
}
