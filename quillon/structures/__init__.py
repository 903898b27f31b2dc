"""Search structures over bounded, sorted data: one shard's or one block's worth."""
