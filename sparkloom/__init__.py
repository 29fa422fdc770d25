"""sparkloom: retrieval evaluation, provenance and corpus analytics as Spark DataFrame plans."""
