"""What the pipeline computes, table by table and model by model."""
