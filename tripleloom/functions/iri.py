"""Relative IRIs."""

from __future__ import annotations

import re
from urllib.parse import urljoin


def resolve(base: str, iri: str) -> str:
    """An absolute IRI as it is, another one against the base. An empty fragment is kept, which the library drops."""
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
        return iri
    out = urljoin(base, iri)
    return out + "#" if iri.endswith("#") and not out.endswith("#") else out
