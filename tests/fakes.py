"""Models for tests. Calls are counted in a file, since they happen in worker processes."""

from pathlib import Path



class CountingEmbedder:
    """Vector: number of letters and of spaces."""

    def __init__(self, log, batch_size=30, model_id="counting"):
        self.log, self.batch_size, self.model_id = str(log), batch_size, model_id

    def embed(self, texts):
        with open(self.log, "a") as f:
            f.write(f"{len(texts)}\n")
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    def embedded(self):
        return sum(int(n) for n in Path(self.log).read_text().split()) if Path(self.log).exists() else 0


class Scripted:
    """Answers or raises what it is told, one item per call."""

    def __init__(self, *script):
        self.script, self.calls, self.batch_size, self.model_id = list(script), 0, 2, "scripted"

    def embed(self, texts):
        step = self.script[min(self.calls, len(self.script) - 1)]
        self.calls += 1
        if isinstance(step, Exception):
            raise step
        return step(texts) if callable(step) else step


class Reader:
    """Answers prompts by their opening words; stumbles over a text holding BROKEN."""

    def answer(self, prompts):
        if any("BROKEN" in p and "degree" in p for p in prompts):
            raise ValueError("cannot read this")
        return [f" {p.split()[2]}:{p[-5:]} " for p in prompts]
