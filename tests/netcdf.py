"""Small netCDF-3 files for tests, with fixed or unlimited time."""

import struct

import numpy as np

CODES = {"f8": 6, "f4": 5, "i4": 4, "i2": 3}


def _text(s):
    b = s.encode()
    return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)


def _attribute(name, value):
    if isinstance(value, str):
        b = value.encode()
        return _text(name) + struct.pack(">ii", 2, len(b)) + b + b"\0" * (-len(b) % 4)
    values = np.asarray(value, ">f8")
    return _text(name) + struct.pack(">ii", 6, values.size) + values.tobytes()


def write_netcdf(path, dims, variables, unlimited=None, wide=False):
    """dims: name -> size; variables: name -> (axes, array, type, attributes)."""
    names = list(dims)
    by_record = {n: v[0][0] == unlimited for n, v in variables.items()}
    raw, size = {}, {}
    for n, (axes, array, kind, _) in variables.items():
        data = np.ascontiguousarray(array, ">" + kind)
        records = [r.tobytes() for r in data] if by_record[n] else [data.tobytes()]
        # A record variable on its own is stored without padding, though its size says so.
        alone = by_record[n] and sum(by_record.values()) == 1
        raw[n] = [r if alone else r + b"\0" * (-len(r) % 4) for r in records]
        size[n] = len(records[0]) + -len(records[0]) % 4
    head = b""
    for attempt in range(2):
        offset, begin = len(head), {}
        for n in sorted(variables, key=lambda n: by_record[n]):
            begin[n] = offset
            offset += size[n]
        out = b"CDF" + bytes([2 if wide else 1])
        out += struct.pack(">i", dims[unlimited] if unlimited else 0)
        out += struct.pack(">ii", 10, len(dims))
        for d, n in dims.items():
            out += _text(d) + struct.pack(">i", 0 if d == unlimited else n)
        out += struct.pack(">ii", 12, 1) + _attribute("title", "made for a test")
        out += struct.pack(">ii", 11, len(variables))
        for n, (axes, _, kind, attributes) in variables.items():
            out += _text(n) + struct.pack(f">i{len(axes)}i", len(axes), *[names.index(a) for a in axes])
            out += struct.pack(">ii", 12 if attributes else 0, len(attributes))
            out += b"".join(_attribute(k, v) for k, v in attributes.items())
            out += struct.pack(">ii", CODES[kind], size[n]) + struct.pack(">q" if wide else ">i", begin[n])
        head = out
    with open(path, "wb") as f:
        f.write(head)
        for n in variables:
            if not by_record[n]:
                f.write(raw[n][0])
        if unlimited:
            for t in range(dims[unlimited]):
                for n in variables:
                    if by_record[n]:
                        f.write(raw[n][t])
