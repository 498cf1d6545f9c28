"""Cut a stream of bytes into records that begin at a mark."""

from __future__ import annotations

import math
from collections.abc import Iterator

_DROP_BYTES = 4 << 20


def cut_records(pieces: Iterator[bytes], mark: bytes, until: float = math.inf, first: bool = True) -> Iterator[bytes]:
    """Records of a stream, each from after the mark's first byte through the next mark's first byte.

    A record is given if its mark begins before byte `until`; it may end behind that. With `first` the bytes up to
    the first mark are a record too. Each byte is searched once, so a long record takes linear time.
    """
    held, base, scanned = bytearray(), 0, 0
    begin = 0 if first else None
    for piece in pieces:
        held += piece
        while (at := held.find(mark, scanned)) >= 0:
            if begin is not None:
                yield bytes(held[begin:at + 1])
            if base + at >= until:
                return
            begin, scanned = at + 1, at + len(mark)
        scanned = max(scanned, len(held) - len(mark) + 1)
        if begin is None and base + scanned >= until:
            return
        done = scanned if begin is None else min(begin, scanned)
        if done >= _DROP_BYTES:
            del held[:done]
            base, scanned = base + done, scanned - done
            begin = None if begin is None else begin - done
    if begin is not None:
        yield bytes(held[begin:])
