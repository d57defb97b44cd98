"""spark-submit entry for the build job (see ledgerlens.plans.job)."""

from ledgerlens.plans.job import main

if __name__ == "__main__":
    main()
