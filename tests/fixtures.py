"""Packages, images and status payloads generated with the standard library."""

from __future__ import annotations

import json
import os
import zipfile

import numpy as np

from folioworks import fixed_values as fv
from folioworks.standins import png_bytes

IMAGE = fv.IMAGE_REL_TYPE
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"


def main_part(paragraphs: int = 2, tables: int = 1, images: int = 1) -> bytes:
    inline = "<w:p><w:r><w:drawing><wp:inline/></w:drawing></w:r></w:p>"
    body = "<w:p/>" * (paragraphs - images) + inline * images + "<w:tbl/>" * tables
    return (
        f'<?xml version="1.0"?><w:document xmlns:w="{W}" xmlns:wp="{WP}">'
        f"<w:body>{body}</w:body></w:document>"
    ).encode()


def rels(*items: tuple, prefix: str = "") -> bytes:
    """Items: (id, type, target[, mode])."""
    p = f"{prefix}:" if prefix else ""
    ns = f"xmlns:{prefix}" if prefix else "xmlns"
    rows = ""
    for item in items:
        mode = f' TargetMode="{item[3]}"' if len(item) > 3 else ""
        rows += f'<{p}Relationship Id="{item[0]}" Type="{item[1]}" Target="{item[2]}"{mode}/>'
    return f'<{p}Relationships {ns}="{fv.NS_RELATIONSHIPS}">{rows}</{p}Relationships>'.encode()


def types(defaults: dict, overrides: dict | None = None) -> bytes:
    rows = "".join(f'<Default Extension="{k}" ContentType="{v}"/>' for k, v in defaults.items())
    rows += "".join(
        f'<Override PartName="{k}" ContentType="{v}"/>' for k, v in (overrides or {}).items()
    )
    return f'<Types xmlns="{fv.NS_CONTENT_TYPES}">{rows}</Types>'.encode()


BASE = {
    fv.CONTENT_TYPES_PART: types(
        {"png": "image/png", "xml": "application/xml"}, {"/word/document.xml": "main"}
    ),
    fv.MAIN_PART: main_part(),
    "word/_rels/document.xml.rels": rels(("rId1", IMAGE, "media/a.png")),
}


def write_package(path, members: dict | list) -> str:
    """A package of ``members`` in order; names ending in ``/`` are folders."""
    rows = members.items() if isinstance(members, dict) else members
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in rows:
            info = zipfile.ZipInfo(name, (2020, 5, 4, 3, 2, 0))
            info.external_attr = 0o600 << 16
            info.compress_type = zipfile.ZIP_STORED if name.endswith(".raw") else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return str(path)


def noise(height: int, width: int, channels: int = 3, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).integers(
        0, 256, (height, width, channels), dtype=np.uint8
    )


def exact_colors(count: int, side: int = 0) -> bytes:
    """A PNG with exactly ``count`` colours."""
    side = max(side, int(np.ceil(np.sqrt(count))))
    numbers = np.minimum(np.arange(side * side), count - 1).reshape(side, side)
    pixels = np.stack([numbers & 255, numbers >> 8, np.zeros_like(numbers)], -1)
    return png_bytes(pixels.astype(np.uint8))


def photo(side: int = 80, alpha: int | None = None) -> bytes:
    """A smooth picture with many colours that packs well."""
    y, x = np.mgrid[0:side, 0:side]
    layers = [(x * 3) & 255, (y * 3) & 255, (x // 8) & 255]
    if alpha is not None:
        layers.append(np.full_like(x, alpha))
    return png_bytes(np.stack(layers, -1).astype(np.uint8))


def write_status(folder, name: str, responses: list[dict]) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as out:
        for response in responses:
            out.write(json.dumps(response) + "\n")


def poll(poll_id: str, device: str, at: str, *readings: tuple, **extra) -> dict:
    return {
        "poll_id": poll_id, "device_id": device, "polled_at": at, "success": True,
        "result": [{"code": c, "value": v} for c, v in readings], **extra,
    }
