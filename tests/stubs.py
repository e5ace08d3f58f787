"""Functions that tests run in Python workers."""

import numpy as np


class Bytes:
    """How often each of four bytes occurs; fails on images with an x."""

    def __call__(self, content):
        if b"x" in content:
            raise OSError("broken image")
        if content == b"none":
            return None
        return [float(content.count(c)) for c in b"abcd"]


class Output:
    def __init__(self, data):
        self.data = data


def model():
    """A function that gives each kind of output a model may give."""

    def run(content):
        kind = bytes(content)
        if kind == b"data":
            return Output([1, 2])
        if kind == b"list":
            return [3.5]
        if kind == b"array":
            return np.array([1.5, 2.5], dtype=np.float32)
        if kind == b"text":
            return "no vector"
        raise RuntimeError("bad image")

    return run


def whole_number(payload):
    if payload is None:
        raise TypeError("no payload")
    return int(payload)


class InLists(Bytes):
    """The same for lists of images; a list with a broken image fails as a whole."""

    def many(self, contents):
        return [self(content) for content in contents]
