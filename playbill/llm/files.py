"""Binary files in the shared folder, written and read by tasks.

A task writes under a name that no other attempt uses and reports it; readers open reported files
only. So the files of lost or repeated attempts do no harm.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as fs


def new_name(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.bin"


@contextmanager
def writing(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        yield out


@contextmanager
def reading(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        yield f
