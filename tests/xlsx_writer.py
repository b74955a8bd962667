"""Minimal .xlsx writer for test fixtures only (inline strings, numbers,
booleans and date-styled serial numbers)."""

from __future__ import annotations

import datetime as dt
import zipfile
from xml.sax.saxutils import escape

_CT = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
       '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
       '<Default Extension="xml" ContentType="application/xml"/>'
       '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
       '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
       '{sheets}</Types>')
_RELS = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
         '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
         '</Relationships>')
_STYLES = ('<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
           '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')


def _col(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{repr(float(v)) if isinstance(v, float) else v}</v></c>'
    if isinstance(v, dt.datetime):
        serial = (v - dt.datetime(1899, 12, 30)).total_seconds() / 86400
        return f'<c r="{ref}" s="1"><v>{serial!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'


def write_xlsx(path: str, sheets: dict[str, list[list]], shared: bool = False,
               date1904: bool = False, custom_date: bool = False) -> str:
    """``sheets``: name → rows (first row = header).  ``shared`` stores text
    in the shared-strings part, ``custom_date`` styles dates with a custom
    number format, ``date1904`` uses the 1904 date system."""
    names = list(sheets)
    sst: list[str] = []
    base = dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 30)

    def cell(ref, v):
        if isinstance(v, dt.datetime):
            serial = (v - base).total_seconds() / 86400
            return f'<c r="{ref}" s="1"><v>{serial!r}</v></c>'
        if shared and isinstance(v, str):
            if v not in sst:
                sst.append(v)
            return f'<c r="{ref}" t="s"><v>{sst.index(v)}</v></c>'
        return _cell(ref, v)

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" '
                       'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                       for i in range(len(names)))
        z.writestr("[Content_Types].xml", _CT.format(sheets=over))
        z.writestr("_rels/.rels", _RELS)
        wb = ('<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
              'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
              + ('<workbookPr date1904="1"/>' if date1904 else "") + "<sheets>"
              + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
              + "</sheets></workbook>")
        z.writestr("xl/workbook.xml", wb)
        rels = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                + "".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
                          f'Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
                + f'<Relationship Id="rId{len(names) + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
                + "</Relationships>")
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        styles = _STYLES
        if custom_date:
            styles = styles.replace('<cellXfs count="2">', '<numFmts count="1"><numFmt numFmtId="164" '
                                    'formatCode="dd/mm/yyyy\\ hh:mm"/></numFmts><cellXfs count="2">')
            styles = styles.replace('numFmtId="22"', 'numFmtId="164"')
        z.writestr("xl/styles.xml", styles)
        for i, n in enumerate(names):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(f"{_col(c)}{r + 1}", v) for c, v in enumerate(row)) + "</row>"
                           for r, row in enumerate(sheets[n]))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml",
                       '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                       f"<sheetData>{body}</sheetData></worksheet>")
        if sst:
            z.writestr("xl/sharedStrings.xml",
                       '<?xml version="1.0" encoding="UTF-8"?><sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                       + "".join(f"<si><t>{escape(t)}</t></si>" for t in sst) + "</sst>")
    return path
