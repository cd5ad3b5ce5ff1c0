"""Thin adapters to the calling conventions of retrieval frameworks; none of them has to be installed."""

from __future__ import annotations

from .engine import Engine


class VectorStore:
    """``add_texts`` and ``similarity_search`` over a table; embedding: an object with embed_query, or None for BM25."""

    def __init__(self, engine: Engine, table: str, embedding=None):
        self.engine, self.table, self.embedding = engine, table, embedding

    def add_texts(self, texts, metadatas=None, **_) -> int:
        metadatas = metadatas or [{}] * len(texts)
        docs = [{"text": t, **(m or {})} for t, m in zip(texts, metadatas)]
        if self.embedding is not None:
            for d, v in zip(docs, self.embedding.embed_documents([d["text"] for d in docs])):
                d["embedding"] = v
        return self.engine.add(self.table, docs)

    def similarity_search(self, query: str, k: int = 4, **_) -> list[dict]:
        vector = list(self.embedding.embed_query(query)) if self.embedding is not None else None
        hits = self.engine.search(self.table, query, top_k=k, strategy="dense" if vector else "sparse", query_vector=vector)
        return [r.asDict() for r in hits.df.collect()]

    # the names that index frameworks use
    def add(self, nodes) -> int:
        return self.add_texts([x if isinstance(x, str) else x.get_content() for x in nodes])

    def query(self, query: str, k: int = 4) -> list[dict]:
        return self.similarity_search(query, k)
