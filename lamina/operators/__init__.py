"""Operations on op logs: batches, resolution of versions, cursor verbs, compaction, metrics."""
