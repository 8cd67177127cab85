"""Network-flow analytics on Spark: packets, flows, embeddings, flow stores."""
