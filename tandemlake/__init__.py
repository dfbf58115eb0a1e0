"""tandemlake: tandem-repeat length analytics expressed as Spark plans."""
