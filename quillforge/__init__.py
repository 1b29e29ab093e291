"""quillforge: a Spark-first engine that curates parallel text for distillation training."""
