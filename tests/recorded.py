"""Stored files by a recorded interface, for formats whose library is not at hand."""

import numpy as np


class Recorded:
    """Stored arrays behind the interface of an HDF5 file: datasets by path, groups by prefix, attributes by "path@name"."""

    def __init__(self, path, at=""):
        self.path, self.at = path, at.strip("/")
        self.data = np.load(path, allow_pickle=True)
        start = self.at + "@"
        self.attrs = {k[len(start) :]: self.data[k].tolist() for k in self.data.files if k.startswith(start)}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.data.close()

    def full(self, key):
        return f"{self.at}/{key.strip('/')}" if self.at else key.strip("/")

    def __contains__(self, key):
        return any(k == self.full(key) or k.startswith(self.full(key) + "/") for k in self.data.files)

    def __getitem__(self, key):
        name = self.full(key)
        return self.data[name] if name in self.data.files else Recorded(self.path, name)
