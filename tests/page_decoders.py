"""Decoders that tests name; pages say what was decoded."""

import os


class Told:
    """Four lines a page; each page that is decoded leaves a file in the folder that the first line names."""

    def __init__(self, content: bytes):
        self.folder, *self.pages = content.decode().split("\n")

    def __len__(self):
        return len(self.pages)

    def __getitem__(self, k):
        with open(os.path.join(self.folder, f"{k}-{os.getpid()}"), "w"):
            pass
        if self.pages[k] == "bad":
            raise ValueError("a bad page")
        return self.pages[k]
